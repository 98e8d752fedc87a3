"""Operator 13, fill-in-the-middle transformation, in Spark SQL functions only.

A text is cut into units; a hash of its id places two cuts between them and chooses the arrangement of what lies in
front of, between and behind the cuts. Sentinels mark the parts, so that the text can be read back from the output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: A line with its end, or what follows the last one.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Infill:
    """``unit``: a pattern whose matches, one after another, are the whole text. ``rate_percent``: documents that are
    transformed; ``spm_percent``: those of them whose suffix comes first.

    No sentinel may hold the first character of one except as its own first: then a sentinel is never read across the
    border of a part, and a text without sentinels comes back exactly.
    """

    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate_percent: int = 100
    spm_percent: int = 50

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or any(m[0] in x[1:] for m in marks for x in marks):
            raise ValueError("sentinels must differ, and their first characters may stand nowhere else in them")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("no sentinel may begin with another")


def _digest(spec: Infill, doc_id: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)


def _number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


NEW = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs: DataFrame, spec: Infill = Infill(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_units, form, prefix_chars, middle_chars, output``.

    ``form`` is plain (the output is the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Plain are
    empty and null texts, texts that hold a sentinel, and those that the rate leaves out; ``prefix_chars`` and
    ``middle_chars`` are null for them. A null id hashes as an empty one; repeated rows come out alike; a text of any
    length is one row's work, in no shuffle; an empty table gives an empty result. Other columns pass through, columns
    of the names above are replaced.
    """
    other = [c for c in docs.columns if c not in NEW]
    marks = (spec.prefix, spec.suffix, spec.middle)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("_d"), text_of(text).alias("_t"), _digest(spec, doc_id).alias("_x"))
    df = df.withColumn("_u", F.regexp_extract_all("_t", F.lit(spec.unit), F.lit(0)))
    n = F.size("_u")
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("_t", F.lit(m))
    plain = (F.col("_t") == "") | marked | (_number(F.col("_x"), 2) % 100 >= spec.rate_percent)
    form = F.when(plain, "plain").when(_number(F.col("_x"), 3) % 100 < spec.spm_percent, "spm").otherwise("psm")
    cut = [(_number(F.col("_x"), k) % (n + 1)).cast("int") for k in (0, 1)]
    df = df.select("_d", "_t", "_u", n.cast("long").alias("_n"), form.alias("_f"), F.least(*cut).alias("_a"), F.greatest(*cut).alias("_b"))
    part = lambda a, b: F.array_join(F.slice("_u", a + 1, b - a), "")
    parts = F.struct(part(F.lit(0), F.col("_a")).alias("p"), part(F.col("_a"), F.col("_b")).alias("m"), part(F.col("_b"), n).alias("s"))
    df = df.select("_d", "_t", "_n", "_f", F.when(F.col("_f") != "plain", parts).alias("_p"))
    p, m, s = (F.col(f"_p.{c}") for c in "pms")
    lit_p, lit_s, lit_m = map(F.lit, marks)
    output = F.when(F.col("_f") == "psm", F.concat(lit_p, p, lit_s, s, lit_m, m)).when(F.col("_f") == "spm", F.concat(lit_s, s, lit_p, p, lit_m, m)).otherwise(F.col("_t"))
    return df.select("_d.*", F.col("_n").alias("n_units"), F.col("_f").alias("form"), F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, spec: Infill = Infill()) -> Column:
    """The text, read back from ``output`` and ``form`` by its sentinels; null for nulls."""
    first = F.when(form == "psm", F.lit(spec.prefix)).otherwise(F.lit(spec.suffix))
    second_is = {"psm": spec.suffix, "spm": spec.prefix}
    tail = F.substring_index(output, spec.middle, -1)
    head = F.substring_index(output, spec.middle, 1)
    one = lambda f: F.substr(F.substring_index(head, second_is[f], 1), F.length(first) + 1)
    two = lambda f: F.substring_index(head, second_is[f], -1)
    return F.when(form == "psm", F.concat(one("psm"), tail, two("psm"))).when(form == "spm", F.concat(two("spm"), tail, one("spm"))).otherwise(output)


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def _sql(s: Infill = Infill()) -> str:
    number = lambda k: f"CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"coalesce(array_to_string(u[{a} + 1:{b}], ''), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{s.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, least({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS a, greatest({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{s.prefix}') OR contains(t, '{s.suffix}') OR contains(t, '{s.middle}') OR {number(2)} % 100 >= {s.rate_percent} THEN 'plain' WHEN {number(3)} % 100 < {s.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, CASE WHEN a > 0 THEN {part('0', 'a')} ELSE '' END AS pre, CASE WHEN b > a THEN {part('a', 'b')} ELSE '' END AS mid, CASE WHEN n > b THEN {part('b', 'n')} ELSE '' END AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{s.prefix}' || pre || '{s.suffix}' || suf || '{s.middle}' || mid ELSE '{s.suffix}' || suf || '{s.prefix}' || pre || '{s.middle}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": _sql()}
