"""Stream records and reference frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import formats as P
from ..operators import headers as H
from ..sources import carriers
from .format_queries import _TEXTS


def reference_frames(spark, sf_dir):
    """References of the packet carrier; a packet counts as golden if its quantiser is above 55."""
    bits = H.fixed_bits(carriers.packets(spark, sf_dir))
    return C.reference_frames(bits.withColumn("is_golden", F.col("quant") > 55))


def stream_catalogue(spark, sf_dir):
    """A record for every customer, as if each were a stream; a fifth of them have no video."""
    n = F.col("c_custkey")
    rows = carriers.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("codec"), (n % 1920 + 1).alias("w"), (n % 1080 + 1).alias("h"))
    chosen = F.element_at(F.array(*[F.lit(f[0]) for f in P.FORMATS]), (n % len(P.FORMATS)).cast("int") + 1)
    joined = rows.withColumn("wanted", chosen).join(F.broadcast(P.pixel_formats(spark)), F.col("wanted") == F.col("name"))  # seven formats
    info = F.when(n % 5 != 0, C.video_info(F.col("w"), F.col("h"), n % 2 == 0, F.col))
    record = joined.withColumn("record", C.codec_record(F.col("codec"), info, F.lit(None).cast("binary")))
    size = C.plane_size(F.col("w"), F.col("h"), F.get("comp_info", F.lit(1)))
    absent = C.plane_size(F.col("w"), F.col("h"), F.get("comp_info", F.lit(4)))
    return record.select(
        "c_custkey",
        C.describe_codec(F.col("record")).alias("text"),
        C.is_video(F.col("record")).alias("is_video"),
        F.col("record.video.bits").cast("long").alias("bits"),
        size["width"].alias("chroma_w"),
        size["height"].alias("chroma_h"),
        absent["width"].alias("absent_w"),
        C.frame_type_text(F.element_at(F.array(*[F.lit(k) for k in C.FRAME_TYPES]), (n % 5).cast("int") + 1)).alias("frame_type"),
    )


ERRORS = (*C.STATUS_OF_ERROR, "Unheard")
KINDS = (*C.BUFFER_KINDS, "data", "none")


def record_texts(spark, sf_dir):
    """Texts and statuses for every customer, as if its key chose a format, an error, a kind of buffer and a component."""
    n = F.col("c_custkey")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names)).cast("int") + 1)
    rows = carriers.table(spark, sf_dir, "customer").select("c_custkey", (n % 1920 + 1).alias("w"), (n % 1080 + 1).alias("h"), pick([f[0] for f in P.FORMATS], n).alias("wanted"))
    joined = rows.join(F.broadcast(P.pixel_formats(spark)), F.col("wanted") == F.col("name"))  # seven formats
    view = C.buffer_view(pick(KINDS, n))
    return joined.select(
        "c_custkey",
        C.describe_video(C.video_info(F.col("w"), F.col("h"), n % 2 == 0, F.col), F.col).alias("video"),
        C.status_of(F.when(n % 9 != 0, pick(ERRORS, n))).alias("status"),
        C.buffer_offset(F.array(n * 0, n * 3, n * 5), (n % 5).cast("int")).alias("offset"),
        view["has_video"].alias("has_video"),
        view["view_bits"].cast("long").alias("view_bits"),
        view["text"].alias("buffer"),
        C.vector_text(n - 700, -n).alias("vector"),
    )


QUERIES = {"record_texts": record_texts, "reference_frames": reference_frames, "stream_catalogue": stream_catalogue}

_FORMAT_TEXTS = ", ".join(f"({k}, '[Formaton for {_TEXTS[f[0]][1]}:  {_TEXTS[f[0]][2]}]')" for k, f in enumerate(P.FORMATS))

ORACLES = {
    "record_texts": f"""
with f(k, text) as (values {_FORMAT_TEXTS}),
c as (select c_custkey, c_custkey as n, text from customer join f on c_custkey % 7 = k)
select c_custkey, (n % 1920 + 1) || 'x' || (n % 1080 + 1) || ' ' || text as video,
  case when n % 9 = 0 then 'OK' else ['ShortData', 'InvalidData', 'InvalidData', 'AllocError', 'AllocError', 'InvalidData'][n % 6 + 1] end as status,
  case n % 5 when 1 then n * 3 when 2 then n * 5 else 0 end::bigint as offset,
  n % 6 < 4 as has_video, [8, 8, 16, 32, null, null][n % 6 + 1]::bigint as view_bits, ['8-bit', 'packed', '16-bit', '32-bit', 'Data buffer', 'No buffer'][n % 6 + 1] as buffer,
  (n - 700) || ',' || (-n) as vector from c""",
    "reference_frames": """
with p as (select user_id as stream_id, event_id as pkt_no, ('0x' || substr(md5(event_id::varchar), 1, 2))::bigint as b from events),
f as (select stream_id, pkt_no, b < 128 as is_intra, (b >> 1) & 63 > 55 as is_golden from p),
g as (select *, sum(case when is_intra then 1 else 0 end) over (partition by stream_id order by pkt_no)::bigint as gop from f),
m as (select *, max(case when is_golden or is_intra then pkt_no end) over (partition by stream_id, gop order by pkt_no rows between unbounded preceding and 1 preceding) as golden,
  max(pkt_no) over (partition by stream_id, gop order by pkt_no rows between unbounded preceding and 1 preceding) as before from g)
select stream_id, pkt_no, case when gop > 0 then before end as last_ref, case when gop > 0 then golden end as golden_ref,
  case when gop > 0 then 'OK' else 'MissingReference' end as status from m""",
    "stream_catalogue": """
with f(k, bits, ss) as (values (0, 24, 1), (1, 24, 2), (2, 32, 2), (3, 32, 1), (4, 24, 0), (5, 16, 0), (6, 24, 0)),
c as (select c_custkey, c_name, c_custkey % 1920 + 1 as w, c_custkey % 1080 + 1 as h, c_custkey % 5 <> 0 as is_video, bits, ss from customer join f on c_custkey % 7 = k)
select c_custkey, c_name || case when is_video then ': ' || w || 'x' || h else ': none' end as text, is_video, case when is_video then bits end::bigint as bits,
  (w + (1 << ss) - 1) >> ss as chroma_w, (h + (1 << ss) - 1) >> ss as chroma_h, 0::bigint as absent_w, ['I', 'P', 'B', 'skip', 'x'][c_custkey % 5 + 1] as frame_type from c""",
}
