"""Header queries over the packet carrier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import byte_at
from ..operators import headers as H
from ..sources import carriers


def _marked(spark, sf_dir):
    """Packets whose second byte, if intra, holds valid version, profile and interlaced fields."""
    n = F.col("pkt_no")
    field = (n % 3 + 6) * 8 + F.floor(n / 3) % 2 * 6 + F.floor(n / 6) % 2
    packets = carriers.packets(spark, sf_dir)
    hexed = F.lpad(F.hex(field.cast("long")), 2, "0")
    intra = byte_at(F.col("data"), 0) < 128
    data = F.hex("data")
    patched = F.when(intra, F.concat(F.substring(data, 1, 2), hexed, F.substring(data, 5, 28))).otherwise(data)
    return packets.withColumn("data", F.unhex(patched))


def hdr_fixed_bits(spark, sf_dir):
    return H.fixed_bits(carriers.packets(spark, sf_dir))


def gop_segments(spark, sf_dir):
    return H.gop_summary(H.fixed_bits(carriers.packets(spark, sf_dir)))


def hdr_inherited_fields(spark, sf_dir):
    found = H.with_inherited(H.fixed_bits(_marked(spark, sf_dir)))
    return found.withColumn("status", H.header_status(F.col("is_intra"), F.col("version"), F.col("profile")))


QUERIES = {"hdr_fixed_bits": hdr_fixed_bits, "gop_segments": gop_segments, "hdr_inherited_fields": hdr_inherited_fields}

_BYTES = """
with p as (select user_id as stream_id, event_id as pkt_no, md5(event_id::varchar) as h from events),
b as (select stream_id, pkt_no, ('0x' || substr(h, 1, 2))::bigint as b0, ('0x' || substr(h, 3, 2))::bigint as b1 from p),
f as (select stream_id, pkt_no, b0 < 128 as is_intra, (b0 >> 1) & 63 as quant, b0 & 1 = 1 as multistream,
  case when b0 < 128 then {b1} end as c from b)
"""
_FIELDS = "c >> 3 as version, (c >> 1) & 3 as profile, c & 1 = 1 as interlaced"

ORACLES = {
    "hdr_fixed_bits": _BYTES.format(b1="b1") + f"select stream_id, pkt_no, is_intra, quant, multistream, {_FIELDS} from f",
    "gop_segments": _BYTES.format(b1="b1")
    + """, g as (select *, sum(case when is_intra then 1 else 0 end) over (partition by stream_id order by pkt_no)::bigint as gop from f)
select stream_id, gop, count(*) as n_packets, sum(case when is_intra then 1 else 0 end)::bigint as n_intra, avg(quant) as mean_quant
from g group by stream_id, gop""",
    "hdr_inherited_fields": _BYTES.format(b1="(6 + pkt_no % 3) * 8 + (pkt_no // 3) % 2 * 6 + (pkt_no // 6) % 2")
    + f""", v as (select *, {_FIELDS} from f),
i as (select stream_id, pkt_no, is_intra, quant, multistream,
  last_value(version ignore nulls) over w as version, last_value(profile ignore nulls) over w as profile,
  last_value(interlaced ignore nulls) over w as interlaced
  from v window w as (partition by stream_id order by pkt_no rows between unbounded preceding and current row))
select *, case when is_intra and (version not between 6 and 8 or profile not in (0, 3)) then 'InvalidData'
  when version is null then 'MissingReference' else 'OK' end as status from i""",
}
