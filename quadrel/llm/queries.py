"""The registered queries of this subpackage, with SQL where it can express one."""

from __future__ import annotations

from . import audio, classifier, pieces, secrets
from .common import table
from .html_text import page_text
from .lm import lm_scores
from .mixing import mix
from .neardup import near_duplicates
from .rules import quality_rules
from .urls import url_filter


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classifier.score(docs, model)


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)


def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_audio(spark, sf_dir):
    """The tables hold no audio; the recordings are the embeddings, played as tunes."""
    return audio.match_recordings(audio.rendered(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def op5_url_filters(spark, sf_dir):
    """Rules are mined from the fixed rules' verdicts: the labels table is of documents, not of pages."""
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url"))


def op6_secret_scans(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op8_html_text(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_pieces(spark, sf_dir):
    return pieces.encoded_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_audio": op4_audio,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_mixing": op7_mixing,
    "op8_html_text": op8_html_text,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_pieces": op10_pieces,
}

OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'text ' || text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
c as (
  select *, sum(source_size) over ()::bigint as total,
    coalesce(sum(2 * source_size) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
    sum(weight) over (w rows between current row and unbounded following)::bigint as weights
  from r window w as (order by source_size / weight, weight, source asc nulls last)),
m as (select *, (3 * total - 2 * capped) * weight >= 4 * source_size * weights as is_capped,
  (3 * total - 2 * capped)::double / 2 / weights as rate from c),
t as (select *, max(case when not is_capped then rate end) over () as best from m),
g as (select source, source_size, case when is_capped then (2 * source_size)::double else best * weight end as target from t),
n as (select d.*, source_size, target, case when target > source_size then 1 else 0 end as base,
  target - case when target > source_size then source_size else 0 end as need
  from d join g on d.source is not distinct from g.source),
q as (select *, sum(size) over (partition by source order by h)::bigint as upto, sum(size) over (partition by source, h)::bigint as words from n)
select doc_id, size, source_size, target,
  (size * (base + case when upto <= need or (upto - words <= need and words < 2 * (need - (upto - words))) then 1 else 0 end))::bigint as taken
from q
"""

ORACLES = {"op7_mixing": OP7_SQL}
