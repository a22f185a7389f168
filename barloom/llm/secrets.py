"""Secret scans: keyword and key patterns, and a battery of randomness tests, in DataFrame functions only.

The base patterns give spans as they stand. The battery looks at every long token:
its encoding is inferred, and under "its symbols are drawn at random" three tests
are made: uniformity of the alphabet (chi-squared), runs above and below the
alphabet's middle, and lag-1 serial correlation. Fisher's method combines them,
and within each class of token lengths the Benjamini-Hochberg step rejects what is
not random; tokens that stay are reported as kind "random". p-values are rounded
up to a fixed grid first, so the step needs only counts per grid point and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import staged

# The base patterns in the order of their kinds.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
#: Tokens that the battery tests.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = [*BASE, "random"]
# Alphabets in the order of their codes.
HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Upper bounds of the length classes; the last class is open.
LENGTHS = (32, 48, 96)
#: Grid points per factor of ten of a p-value, and the last grid point.
GRID, LAST = 50, 3000


def _hits(text: Column, pattern: str, cheap: Column) -> Column:
    """Struct of the matches and of the lengths of the text's parts before each."""
    parts = F.transform(F.split(text, pattern, -1), F.length)
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), parts.alias("gap"))
    return F.when(cheap, found)


def matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row and kind with hits: the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cheap = {
        "assign": text.rlike("(?i:password|passwd|secret|token|api_?key)"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(BASE["hex"]),
        "random": text.rlike(TOKEN),
    }
    hits = {kind: _hits(text, pattern, cheap[kind]).alias(kind) for kind, pattern in (BASE | {"random": TOKEN}).items()}
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *hits.values())


def _spans(found: DataFrame) -> DataFrame:
    """One row per hit: row, order (of the kind), start, end (code points, end exclusive), hit."""
    kinds = F.array(*[F.struct(F.lit(i).alias("order"), F.col(f"{k}.hit").alias("hit"), F.col(f"{k}.gap").alias("gap")) for i, k in enumerate(KINDS)])
    rows = found.select("row", F.explode(kinds).alias("of")).filter("of.hit IS NOT NULL")
    rows = rows.select("row", "of.order", F.posexplode(F.arrays_zip("of.hit", "of.gap"))).filter("col.hit IS NOT NULL")
    size = F.length("col.hit")
    end = F.sum(size + F.col("col.gap")).over(W.partitionBy("row", "order").orderBy("pos"))
    return rows.select("row", "order", (end - size).alias("start"), end.alias("end"), F.col("col.hit").alias("hit"))


def normal_tail(z: Column) -> Column:
    """P(|N(0,1)| > |z|), by the rational approximation 7.1.26 of Abramowitz and Stegun (error 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def battery(tokens: DataFrame, token: str = "hit") -> DataFrame:
    """tokens with encoding, p_uniform, p_runs, p_serial and p_random (Fisher's combination)."""
    text = F.col(token)
    encoding = F.when(text.rlike("^[0-9]+$"), "decimal").when(text.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
    encoding = encoding.when(text.rlike("^(?=.*[2-7])[A-Z2-7]+$"), "base32").otherwise("base64")
    out = tokens.withColumn("encoding", encoding)
    alphabet = F.when(F.col("encoding") == "decimal", HEX[:10]).when(F.col("encoding") == "hex", HEX)
    out = out.withColumn("_alphabet", alphabet.when(F.col("encoding") == "base32", BASE32).otherwise(BASE64))
    plain = F.when(F.col("encoding") == "hex", F.lower(text)).when(F.col("encoding") == "base64", F.translate(text, "-_", "+/")).otherwise(text)
    out = out.withColumns({"_plain": plain, "_n": F.length(text).cast("double"), "_a": F.length("_alphabet").cast("double")})
    counts = F.transform(F.split("_alphabet", ""), lambda c: F.length("_plain") - F.length(F.replace(F.col("_plain"), c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n.cast("double") * n)
    out = out.withColumn("_codes", F.expr("transform(split(_plain, ''), c -> cast(instr(_alphabet, c) - 1 as double))"))
    out = out.withColumn("_mean", F.expr("aggregate(_codes, 0D, (s, x) -> s + x) / _n"))
    out = out.withColumn("_pairs", F.expr("zip_with(slice(_codes, 1, size(_codes) - 1), slice(_codes, 2, size(_codes) - 1), (x, y) -> struct(x, y))"))
    out = out.withColumns(
        {
            "_squares": squares,
            "_above": F.expr("cast(size(filter(_codes, x -> x >= _a / 2)) as double)"),
            "_runs": F.expr("1D + size(filter(_pairs, p -> (p.x >= _a / 2) <> (p.y >= _a / 2)))"),
            "_var": F.expr("aggregate(_codes, 0D, (s, x) -> s + (x - _mean) * (x - _mean))"),
            "_cov": F.expr("aggregate(_pairs, 0D, (s, p) -> s + (p.x - _mean) * (p.y - _mean))"),
        }
    )
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    out = out.withColumn("_chi", F.expr("greatest(_a / _n * _squares - _n, 0D)"))
    z_chi = F.expr("(power(_chi / (_a - 1), 1D / 3) - (1 - 2 / (9 * (_a - 1)))) / sqrt(2 / (9 * (_a - 1)))")
    upper = F.when(z_chi > 0, normal_tail(z_chi) / 2).otherwise(1 - normal_tail(z_chi) / 2)
    out = out.withColumn("_both", F.expr("2 * _above * (_n - _above)"))
    z_runs = F.expr("(_runs - (_both / _n + 1)) / sqrt(_both * (_both - _n) / (_n * _n * (_n - 1)))")
    never = F.lit(1e-60)
    out = out.withColumns(
        {
            "p_uniform": F.greatest(upper, never),
            "p_runs": F.when(F.expr("_both > _n"), F.greatest(normal_tail(z_runs), never)).otherwise(F.greatest(F.pow(F.lit(0.5), F.col("_n") - 1), never)),
            "p_serial": F.when(F.col("_var") > 0, F.greatest(normal_tail(F.expr("_cov / _var * sqrt(_n)")), never)).otherwise(never),
        }
    )
    half = -(F.ln("p_uniform") + F.ln("p_runs") + F.ln("p_serial"))
    out = out.withColumn("p_random", F.greatest(F.exp(-half) * (1 + half + half * half / 2), never))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def length_class(size: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, upper in reversed(list(enumerate(LENGTHS))):
        out = F.when(size < upper, i).otherwise(out)
    return out


def not_rejected(tested: DataFrame, token: str = "hit", rate: float = 0.05) -> DataFrame:
    """The rows of tested whose randomness the Benjamini-Hochberg step of their length class doesn't reject."""
    grid = F.least(F.floor(-F.log10("p_random") * GRID), F.lit(LAST)).cast("int")
    rows = tested.withColumns({"_class": length_class(F.length(token)), "_grid": grid})
    counts = rows.groupBy("_class", "_grid").agg(F.count("*").alias("n"))
    by_class = W.partitionBy("_class")
    rank = F.sum("n").over(by_class.orderBy(F.col("_grid").desc()))
    steps = counts.withColumns({"rank": rank, "all": F.sum("n").over(by_class)})
    steps = steps.filter(F.pow(F.lit(10.0), -F.col("_grid") / F.lit(float(GRID))) <= F.lit(rate) * F.col("rank") / F.col("all"))
    # one row per length class
    limits = F.broadcast(steps.groupBy("_class").agg(F.min("_grid").alias("_limit")))
    kept = rows.join(limits, "_class", "left").filter("_limit IS NULL OR _grid < _limit")
    return kept.drop("_class", "_grid", "_limit")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Per input row: id, base and spans, both arrays of struct(start, order, kind, end) by start, then kind.

    Offsets are code points, end exclusive. base holds assign (values of 6 or more
    characters), access (20 or more) and hex (24 or more) spans, leftmost and not
    overlapping within their kind; spans adds "random" ones. Null and empty texts
    have none. Repeated rows are returned as often as they occur; extra columns
    are ignored. Texts are read once and never shuffled.
    """
    found = staged(matches(df, id_col, text_col), "secrets")
    every = _spans(found)
    value = F.regexp_extract("hit", BASE["assign"], 2)
    enough = ((F.col("order") == 0) & (F.length(value) >= 6)) | ((F.col("order") == 1) & (F.length("hit") >= 20)) | (F.col("order") == 2)
    base = every.filter("order < 3").filter(enough).drop("hit")
    tested = staged(battery(every.filter("order = 3")), "battery")
    both = base.unionByName(not_rejected(tested, rate=rate).select(base.columns))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    span = F.struct("start", "order", kind.alias("kind"), "end")
    spans = both.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.select("row", "id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("array()")))
    return out.select(F.col("id").alias(id_col), F.filter("spans", lambda s: s["order"] < 3).alias("base"), "spans")
