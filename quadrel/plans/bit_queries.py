"""Bit readers, arithmetic-coded decisions and probability formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.fixed import long, prob_weight, rescale_prob
from ..functions.tables import DC_WEIGHTS
from ..operators import entropy as E
from ..operators.entropy import bool_decisions, huffman_weights, mode_probs
from ..sources import carriers


def bits_read_be(spark, sf_dir):
    d = F.col("data")
    return carriers.packets(spark, sf_dir).select(
        "pkt_no",
        B.read_bits(d, 0, 17).alias("first17"),
        B.read_bits(d, 3, 32).alias("at3"),
        B.read_bits(d, 45, 9).alias("at45"),
        B.read_bits(d, 120, 9).alias("past_end"),
        B.left(d, 45).alias("bits_left"),
        F.lit(B.align(17)).cast("long").alias("aligned"),
    )


def bits_read_signed(spark, sf_dir):
    d = F.col("data")
    return carriers.packets(spark, sf_dir).select(
        "pkt_no", B.read_signed(d, 0, 5).alias("s5"), B.read_signed(d, 11, 16).alias("s16"), B.read_signed(d, 40, 32).alias("s32")
    )


def bits_read_modes(spark, sf_dir):
    d = F.col("data")
    cols = [B.read_bits(d, 5, 13, m).alias(f"m_{m}") for m in ("be", "le", "le16msb", "le32msb")]
    return carriers.packets(spark, sf_dir).select("pkt_no", *cols)


def bits_reverse(spark, sf_dir):
    d = F.col("data")
    return carriers.packets(spark, sf_dir).select(
        "pkt_no", B.reverse_bits(B.read_bits(d, 0, 6), 6).alias("r6"), B.reverse_bits(B.read_bits(d, 0, 32), 32).alias("r32")
    )


def _places(spark, sf_dir):
    """Packets with a place in or behind them and a number of bits."""
    return carriers.packets(spark, sf_dir).select("pkt_no", "data", (F.col("pkt_no") % 150).alias("at"), (F.col("pkt_no") * 7 % 200).alias("n"))


def bits_peek(spark, sf_dir):
    d, at = F.col("data"), F.col("at")
    cols = [B.peek_at(d, at, n).alias(f"next{n}") for n in (0, 1, 7, 32, 33)] + [B.peek_at(d, at, 11, low_first=True).alias("low11")]
    return _places(spark, sf_dir).select("pkt_no", *cols)


def bits_skip(spark, sf_dir):
    return _places(spark, sf_dir).select("pkt_no", B.skipped(F.col("data"), F.col("at") % 128, F.col("n")).alias("place"))


def bits_seek(spark, sf_dir):
    return _places(spark, sf_dir).select("pkt_no", B.sought(F.col("data"), F.col("at")).alias("place"))


def bits_align(spark, sf_dir):
    return _places(spark, sf_dir).select("pkt_no", F.col("at").alias("start"), B.aligned(F.col("at")).alias("place"))


def bool_read_numbers(spark, sf_dir):
    """Numbers of four, eight and seven decisions, the last one a probability, and a signed one of five."""
    bits = F.col("bits")
    found = carriers.packets(spark, sf_dir).select("pkt_no", bool_decisions(F.col("data"), [128] * 24).alias("bits"))
    return found.select(
        "pkt_no",
        E.decided_number(bits, 0, 4).alias("four"),
        E.decided_number(bits, 4, 8).alias("byte"),
        E.decided_signed(bits, 12, 5).alias("signed"),
        E.decided_probability(bits, 17).alias("probability"),
        E.decided_number(bits, 20, 5).alias("past_end"),
    )


def bool_decode_p128(spark, sf_dir):
    return carriers.packets(spark, sf_dir).select("pkt_no", bool_decisions(F.col("data"), [128] * 16).alias("bits"))


def bool_decode_prob(spark, sf_dir):
    return carriers.packets(spark, sf_dir).select("pkt_no", bool_decisions(F.col("data"), [(37 * i + 11) % 255 + 1 for i in range(24)]).alias("bits"))


def _probs(spark, sf_dir):
    n, d = F.coalesce("n_chars", F.lit(0)), F.col("doc_id")
    return carriers.table(spark, sf_dir, "documents").select("doc_id", (n % 255 + 1).alias("p"), (d % 255 + 1).alias("q"), (n + d).alias("s"))


def rescale_probs(spark, sf_dir):
    cols = [
        rescale_prob(F.col("p"), F.lit(w[0]), F.lit(w[1])).alias(f"k{k}_{i}") for k, row in enumerate(DC_WEIGHTS) for i, w in enumerate(row)
    ]
    return _probs(spark, sf_dir).select("doc_id", *cols)


def prob_weights(spark, sf_dir):
    p, q = F.col("p"), F.col("q")
    return _probs(spark, sf_dir).select("doc_id", prob_weight(p, q).alias("both"), prob_weight(255 - p, q).alias("other"))


def mode_prob_table(spark, sf_dir):
    s = F.col("s")
    xs = [((s * (i * 2 + 3)) % 256).alias(f"x{i}") for i in range(20)]
    rows = _probs(spark, sf_dir).select("doc_id", F.array(*xs).alias("sent"))
    modes = rows.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(9))))
    probs = [p.alias(f"p{i}") for i, p in enumerate(mode_probs(F.col("sent"), F.col("mode")))]
    return modes.select("doc_id", long(F.col("mode")).alias("mode"), *probs)


def huffman_weight_table(spark, sf_dir):
    s = F.col("s")
    probs = F.array(*[(s * (i * 2 + 3)) % 254 + 1 for i in range(11)])
    rows = _probs(spark, sf_dir).select("doc_id", probs.alias("probs"))
    return rows.select("doc_id", *[w.alias(f"w{i}") for i, w in enumerate(huffman_weights(F.col("probs")))])


def huffman_run_weights(spark, sf_dir):
    s = F.col("s")
    rows = _probs(spark, sf_dir).select("doc_id", F.array(*[(s * (i * 2 + 3)) % 254 + 1 for i in range(8)]).alias("probs"))
    return rows.select("doc_id", *[w.alias(f"w{i}") for i, w in enumerate(E.run_weights(F.col("probs")))])


QUERIES = {
    f.__name__: f
    for f in (
        bits_read_be,
        bits_read_signed,
        bits_read_modes,
        bits_reverse,
        bits_peek,
        bits_skip,
        bits_seek,
        bits_align,
        bool_read_numbers,
        huffman_run_weights,
        bool_decode_p128,
        bool_decode_prob,
        rescale_probs,
        prob_weights,
        mode_prob_table,
        huffman_weight_table,
    )
}

# A packet as a string of 128 binary digits, and as 16 numbers.
_BITS = """
with p as (select event_id as pkt_no, md5(event_id::varchar) as h from events),
y as (select pkt_no, list_transform(range(16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as b from p),
t as (select pkt_no, b, array_to_string(list_transform(b, lambda x: lpad(bin(x), 8, '0')), '') as z from y),
n as (select 1)
"""


def _number(text: str, n: int) -> str:
    """SQL for the value of ``n`` binary digits."""
    return "(" + " + ".join(f"(substr({text}, {k + 1}, 1) = '1')::bigint * {1 << (n - 1 - k)}" for k in range(n)) + ")"


def _at(z: str, at: int, n: int) -> str:
    return _number(f"substr({z}, {at + 1}, {n})", n)


def _signed(z: str, at: int, n: int) -> str:
    return f"{_at(z, at, n)} - (substr({z}, {at + 1}, 1) = '1')::bigint * {1 << n}"


def _ordered(order) -> str:
    digits = ", ".join(f"lpad(bin(b[{k // 4 * 4 + order[k % 4] + 1}]), 8, '0')" for k in range(16))
    return f"array_to_string([{digits}], '')"


def _decisions(probs: list) -> str:
    """A recursive query: one step per decision, state in columns."""
    chosen = "[" + ", ".join(map(str, probs)) + "]"
    return f"""
with recursive y as (
  select event_id as pkt_no, list_transform(range(16), lambda i: ('0x' || substr(md5(event_id::varchar), 2 * i + 1, 2))::bigint) as b from events),
s as (
  select pkt_no, b, 0 as i, ((b[1] * 256 + b[2]) * 256 + b[3]) * 256 + b[4] as v, 255::bigint as r, 8::bigint as left_, 4::bigint as pos, '' as bits from y
  union all
  select pkt_no, b, i + 1, case when hit then v3 - (split << 24) else v3 end, case when hit then r2 - split else split end, left3, pos3,
    bits || case when hit then '1' else '0' end
  from (
    select *, v3 >= (split << 24) as hit from (
      select *, 1 + (((r2 - 1) * {chosen}[i + 1]) >> 8) as split,
        case when left2 <= 0 and pos < 16 then v2 | (b[pos + 1] << (-left2)::int) else v2 end as v3,
        case when left2 <= 0 and pos < 16 then left2 + 8 else left2 end as left3,
        case when left2 <= 0 and pos < 16 then pos + 1 else pos end as pos3
      from (
        select *, r * k as r2, (v * k) & 4294967295 as v2, left_ - n as left2 from (
          select *, 1 << n as k from (
            select *, case when r >= 128 then 0 when r >= 64 then 1 when r >= 32 then 2 when r >= 16 then 3 when r >= 8 then 4 when r >= 4 then 5 when r >= 2 then 6 else 7 end as n
            from s where i < {len(probs)}))))))
select pkt_no, bits from s where i = {len(probs)}"""


_PROBS = """with d as (select doc_id, coalesce(n_chars, 0) % 255 + 1 as p, doc_id % 255 + 1 as q, coalesce(n_chars, 0) + doc_id as s from documents) """


def _share(a: str, b: str) -> str:
    return f"((255 * ({a}) // (1 + ({b}))) & 255)"


def _mode_sql() -> str:
    x = lambda i: f"(s * {i * 2 + 3}) % 256"
    count = lambda i: f"(case when mode = {i} then 0 else 100 * ({x(2 * i)}) end)"
    own = "case mode " + " ".join(f"when {m} then {x(2 * m)}" for m in range(10)) + " end"
    keep = "case mode " + " ".join(f"when {m} then {x(2 * m + 1)}" for m in range(10)) + " end"
    cs = ", ".join(f"{count(i)} as c{i}" for i in range(10))
    return (
        _PROBS
        + f""", m as (select *, unnest(range(10)) as mode from d),
k as (select doc_id, mode, {own} as own, {keep} as keep, {cs} from m)
select doc_id, mode::bigint as mode,
  1 + {_share('c0+c2+c3+c4', 'c0+c1+c2+c3+c4+c5+c6+c7+c8+c9')} as p0, 1 + {_share('c0+c2', 'c0+c2+c3+c4')} as p1,
  1 + {_share('c1+c7', 'c1+c7+c5+c6+c8+c9')} as p2, 1 + {_share('c0', 'c0+c2')} as p3, 1 + {_share('c3', 'c3+c4')} as p4,
  1 + {_share('c1', 'c1+c7')} as p5, 1 + {_share('c5+c6', 'c5+c6+c8+c9')} as p6, 1 + {_share('c5', 'c5+c6')} as p7,
  1 + {_share('c8', 'c8+c9')} as p8, 255 - {_share('keep', 'own+keep')} as p9
from k"""
    )


def _weights_sql() -> str:
    w = lambda a, b: f"greatest(1, (({a}) * ({b})) >> 8)"
    no = lambda x: f"(255 - {x})"
    ps = ", ".join(f"(s * {i * 2 + 3}) % 254 + 1 as p{i}" for i in range(11))
    return (
        _PROBS
        + f""", a as (select doc_id, {ps} from d),
r as (select *, {w(no('p0'), no('p2'))} as big from a),
t as (select *, {w('big', 'p3')} as two, {w('big', no('p3'))} as high from r),
u as (select *, {w('two', no('p4'))} as t34, {w('high', 'p6')} as c1, {w('high', no('p6'))} as c36 from t),
x as (select *, {w('c36', 'p8')} as c3, {w('c36', no('p8'))} as c4 from u)
select doc_id, {w('p0', no('p1'))} as w0, {w(no('p0'), 'p2')} as w1, {w('two', 'p4')} as w2, {w('t34', 'p5')} as w3, {w('t34', no('p5'))} as w4,
  {w('c1', 'p7')} as w5, {w('c1', no('p7'))} as w6, {w('c3', 'p9')} as w7, {w('c3', no('p9'))} as w8, {w('c4', 'p10')} as w9, {w('c4', no('p10'))} as w10,
  {w('p0', 'p1')} as w11 from x"""
    )


_AT = "with k as (select event_id as pkt_no, event_id % 150 as start, event_id * 7 % 200 as n from events) "


def _peek_sql() -> str:
    """Digits of the packet with zeros behind them; for the lowest bit first, digits of the reversed bytes from the right."""
    shown = ", ".join(f"{_number(f'substr(w, start + 1, {n})', n)} as next{n}" for n in (1, 7, 32))
    return (
        _BITS
        + f""", w as (select pkt_no, pkt_no % 150 as start, rpad(z, 256, '0') as w, lpad(array_to_string(list_reverse(list_transform(b, lambda x: lpad(bin(x), 8, '0'))), ''), 256, '0') as v from t)
select pkt_no, 0::bigint as next0, 0::bigint as next33, {shown}, {_number('substr(v, 256 - start - 10, 11)', 11)} as low11 from w"""
    )


def _run_sql() -> str:
    w = lambda a, b: f"greatest(1, (({a}) * ({b})) >> 8)"
    no = lambda x: f"(255 - {x})"
    ps = ", ".join(f"(s * {i * 2 + 3}) % 254 + 1 as p{i}" for i in range(8))
    return (
        _PROBS
        + f""", a as (select doc_id, {ps} from d),
b as (select *, {w('p0', 'p1')} as r03, {w(no('p0'), 'p4')} as r47, {w(no('p0'), no('p4'))} as w8 from a),
c as (select *, {w('p0', no('p1'))} as r23 from b),
e as (select *, {w('r47', 'p5')} as r45, {w('r47', no('p5'))} as r67 from c)
select doc_id, {w('r03', 'p2')} as w0, {w('r03', no('p2'))} as w1, {w('r23', 'p3')} as w2, {w('r23', no('p3'))} as w3,
  {w('r45', 'p6')} as w4, {w('r45', no('p6'))} as w5, {w('r67', 'p7')} as w6, {w('r67', no('p7'))} as w7, w8 from e"""
    )


ORACLES = {
    "bits_peek": _peek_sql(),
    "bits_skip": _AT + "select pkt_no, case when start % 128 + n <= 128 or (start % 128 + n) % 32 = 0 then start % 128 + n end as place from k",
    "bits_seek": _AT + "select pkt_no, case when start <= 128 then start end as place from k",
    "bits_align": _AT + "select pkt_no, start, case when start % 8 = 0 then start else start + 8 - start % 8 end as place from k",
    "bool_read_numbers": f"""select pkt_no, {_at('bits', 0, 4)} as four, {_at('bits', 4, 8)} as byte, {_signed('bits', 12, 5)} as signed,
  greatest(1, 2 * {_at('bits', 17, 7)}) as probability, null::bigint as past_end from ({_decisions([128] * 24)})""",
    "huffman_run_weights": _run_sql(),
    "bits_read_be": _BITS
    + f"select pkt_no, {_at('z', 0, 17)} as first17, {_at('z', 3, 32)} as at3, {_at('z', 45, 9)} as at45, null::bigint as past_end, 83::bigint as bits_left, 24::bigint as aligned from t",
    "bits_read_signed": _BITS + f"select pkt_no, {_signed('z', 0, 5)} as s5, {_signed('z', 11, 16)} as s16, {_signed('z', 40, 32)} as s32 from t",
    "bits_read_modes": _BITS
    + f""", o as (select pkt_no, z, b, {_ordered(B.ORDERS['le16msb'])} as z16, {_ordered(B.ORDERS['le32msb'])} as z32 from t)
select pkt_no, {_at('z', 5, 13)} as m_be, ((b[1] + b[2] * 256 + b[3] * 65536) >> 5) & 8191 as m_le, {_at('z16', 5, 13)} as m_le16msb, {_at('z32', 5, 13)} as m_le32msb from o""",
    "bits_reverse": _BITS + f"select pkt_no, {_number('reverse(substr(z, 1, 6))', 6)} as r6, {_number('reverse(substr(z, 1, 32))', 32)} as r32 from t",
    "bool_decode_p128": _decisions([128] * 16),
    "bool_decode_prob": _decisions([(37 * i + 11) % 255 + 1 for i in range(24)]),
    "rescale_probs": _PROBS
    + "select doc_id, "
    + ", ".join(f"greatest(1, least(255, ((p * {w[0]} + 128) >> 8) + ({w[1]}))) as k{k}_{i}" for k, row in enumerate(DC_WEIGHTS) for i, w in enumerate(row))
    + " from d",
    "prob_weights": _PROBS + "select doc_id, greatest(1, (p * q) >> 8) as both, greatest(1, ((255 - p) * q) >> 8) as other from d",
    "mode_prob_table": _mode_sql(),
    "huffman_weight_table": _weights_sql(),
}
