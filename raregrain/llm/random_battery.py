"""Secret scan: fixed patterns plus a randomness test battery, in DataFrame operations only.

Base kinds are patterns with lengths. The battery looks at every other run of key-like characters: its
encoding is inferred, and three tests ask whether its symbols could be uniform random draws from that
encoding's alphabet: chi-squared of the symbol counts, runs above and below the alphabet's middle, and
lag-1 serial correlation; Fisher's method joins their p-values. Whether a band of lengths may report
at all, and from which p-value on, is decided by false-discovery control: the corpus's own long plain
words, of about the band's length or shorter and tested as if they were in the encoding, give the share of
ordinary text that reaches a p-value, and the lowest p-value is taken at which the expected share of
ordinary strings among the reported ones is at most `q`.

Defined cases: null text is empty; empty texts have no spans; repeated rows get equal results; runs of
digits only and plain words are no keys; runs shorter than `MIN_LENGTH` are left to the base kinds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.llm.common import shared

#: Base patterns, in the order of the kinds (fixed values).
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_ASSIGNED, MIN_LENGTH = 12, 20

KEY = "A-Za-z0-9+/_-"
#: Runs of key characters that are neither one plain word nor digits only.
TOKEN = rf"(?<![{KEY}])(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?![{KEY}]))[{KEY}]{{{MIN_LENGTH},}}+={{0,2}}"
PLAIN = r"[A-Za-z]{12,}"
KINDS = ["assign", "access", "hex", "random"]

#: Encodings: pattern and alphabet in the order in which symbols get their numbers (fixed values).
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
]
#: Plain words are tested as strings of these encodings; encodings that no word can be in borrow another's result.
AS_ENCODED = ["base32", "base36", "base62", "base64", "base64url"]
BORROWS = {"hex": "base36", "HEX": "base32", "mixed": "base64url"}
#: Plain words of a band and those below it are pooled until there are so many.
REFERENCES = 200
#: Lower ends of the bands of lengths.
BANDS = [12, 20, 24, 32, 48, 64, 128]
GRID = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05]
Q = 0.05


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return poly * F.exp(-x * x)


def _two_sided(z: Column) -> Column:
    return F.greatest(_erfc(F.abs(z) / F.lit(2 ** 0.5)), F.lit(1e-300))


def with_randomness(rows: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding (unless there), n (symbols) and p: the joint p-value of "drawn uniformly from the encoding's alphabet"."""
    body = F.regexp_replace(token, "=+$", "")
    name = F.coalesce(*[F.when(F.col(token).rlike(p), F.lit(e)) for e, p, _ in ENCODINGS])
    alphabet = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(a)) for e, _, a in ENCODINGS])
    x = (rows if "encoding" in rows.columns else rows.withColumn("encoding", name)).withColumn("_body", body).withColumn("_abc", alphabet)
    x = x.withColumn("_k", F.length("_abc").cast("double")).withColumn("n", F.length("_body").cast("double"))
    x = x.withColumn("_i", F.expr("transform(split(_body, ''), c -> cast(instr(_abc, c) - 1 as double))")).withColumn("_mid", F.col("_k") / 2)
    squares = F.expr("aggregate(transform(split(_abc, ''), c -> n - length(replace(_body, c, ''))), 0D, (a, c) -> a + c * c)")
    x = x.withColumn("_sq", squares)
    x = x.withColumn("_n1", F.expr("cast(size(filter(_i, v -> v >= _mid)) as double)"))
    x = x.withColumn("_runs", F.expr("1 + aggregate(sequence(1, greatest(size(_i) - 1, 1)), 0, (a, j) -> a + if((get(_i, j) >= _mid) != (get(_i, j - 1) >= _mid), 1, 0))"))
    x = x.withColumn("_lag", F.expr("aggregate(sequence(1, greatest(size(_i) - 1, 1)), 0D, (a, j) -> a + coalesce((get(_i, j) - (_k - 1) / 2) * (get(_i, j - 1) - (_k - 1) / 2), 0D))"))
    n, k, n1 = F.col("n"), F.col("_k"), F.col("_n1")
    n2 = n - n1
    chi = (k / n * F.col("_sq") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    p_chi = F.when(chi >= 0, _two_sided(chi) / 2).otherwise(1 - _two_sided(chi) / 2)
    expected = 2 * n1 * n2 / n + 1
    spread = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    p_runs = F.when(spread > 0, _two_sided((F.col("_runs") - expected) / F.sqrt(F.greatest(spread, F.lit(1e-12))))).otherwise(F.lit(1e-12))
    p_lag = _two_sided(F.col("_lag") / ((k * k - 1) / 12) / F.sqrt(n - 1))
    x = x.withColumn("_f", -(F.log(F.greatest(p_chi, F.lit(1e-300))) + F.log(p_runs) + F.log(p_lag)))
    # half of Fisher's statistic f: the upper tail of chi-squared with six degrees of freedom
    f = F.col("_f")
    return x.withColumn("p", F.exp(-f) * (1 + f + f * f / 2)).drop("_body", "_abc", "_k", "_i", "_mid", "_sq", "_n1", "_runs", "_lag", "_f")


def _band(length: Column) -> Column:
    return F.greatest(*[F.when(length >= b, F.lit(i)).otherwise(F.lit(0)) for i, b in enumerate(BANDS)])


def _matches(text: Column, pattern: str, kind: str, passes) -> Column:
    """Every match in order with the gap before it: linear in the text; positions follow by summing up."""
    parts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    rows = F.transform(F.arrays_zip(parts.alias("gap"), whole.alias("hit"), values.alias("value")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
        passes(F.length(x["value"])).alias("passes"),
        (x["hit"] if kind == "random" else F.lit(None).cast("string")).alias("token")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(
        F.expr("array()").cast("array<struct<kind:string,i:int,gap:int,len:int,passes:boolean,token:string>>"))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _t, kind, start, end, passes, token: each match of each kind with its place in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    yes = lambda n: n > 0
    kinds = [("assign", ASSIGN, lambda n: n >= MIN_ASSIGNED), ("access", ACCESS, yes), ("hex", HEX, yes), ("random", TOKEN, yes)]
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.concat(*[_matches(text, p, k, f) for k, p, f in kinds]).alias("m"))
    # outer, so that no filter on the array's size, which would search the texts again, is put below it
    flat = rows.select("doc_id", "_t", F.explode_outer("m").alias("m")).select("doc_id", "_t", "m.*").filter(F.col("kind").isNotNull())
    # equal rows of the table give equal matches; one of them stays
    flat = flat.repartition("doc_id", "_t").dropDuplicates(["doc_id", "_t", "kind", "i"])
    upto = Window.partitionBy("doc_id", "_t", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).select("doc_id", "_t", "kind", "start", "end", "passes", "token")


def as_encoded(words: DataFrame) -> DataFrame:
    """Each plain word as a string of every encoding of `AS_ENCODED`, in that encoding's case."""
    case = {"base32": F.upper("token"), "base36": F.lower("token")}
    return words.select(F.explode(F.array(*[F.struct(F.lit(e).alias("encoding"), case.get(e, F.col("token")).alias("token")) for e in AS_ENCODED])).alias("x")).select("x.*")


def thresholds(candidates: DataFrame, ordinary: DataFrame, q: float = Q) -> dict[tuple[str, int], float]:
    """Per encoding and band of lengths the lowest p-value of `GRID` from which on strings may be reported; no entry: none.

    Both inputs have `encoding`, `len` and `p`. Counts per encoding, band and grid step reach the driver, a few hundred numbers.
    """
    def counts(rows):
        got = rows.select("encoding", _band(F.col("len")).alias("band"), "p").groupBy("encoding", "band").agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("p") >= t).alias(f"g{i}") for i, t in enumerate(GRID)]).collect()
        return {(r["encoding"], r["band"]): r for r in got}
    seen, plain = counts(candidates), counts(ordinary)
    cut = {}
    for (encoding, band), r in seen.items():
        pool = []
        for b in range(band, -1, -1):  # the tests gain power with length, so shorter words only make the estimate careful
            x = plain.get((BORROWS.get(encoding, encoding), b))
            if x and sum(y["n"] for y in pool) < REFERENCES:
                pool.append(x)
        n0 = sum(x["n"] for x in pool)
        for i, t in enumerate(GRID):
            share = (sum(x[f"g{i}"] for x in pool) + 1) / (n0 + 1)
            if r[f"g{i}"] and r["n"] * share / r[f"g{i}"] <= q:
                cut[encoding, band] = t
                break
    return cut


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, _t, spans (array of start, end, kind number, kind), for documents that have any.

    Matches are written once (without the texts); a battery span that touches a base span is left out,
    found by running extremes over the document's spans in order.
    """
    own = docs.select("doc_id", "text")
    places = shared(found_spans(own).filter("passes"))
    # each distinct string is tested once, however often it stands in the corpus
    tested = shared(with_randomness(places.filter("kind = 'random'").groupBy("token").agg(F.count(F.lit(1)).alias("times")))
                    .select("token", "encoding", "p", F.length("token").alias("len")))
    plain = own.select(F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({PLAIN})"), 1)).alias("token")).filter(
        F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    cut = thresholds(tested, with_randomness(as_encoded(plain)).select("encoding", "p", F.length("token").alias("len")), q)
    limit = F.lit(None).cast("double")
    for (encoding, band), t in cut.items():
        limit = F.when((F.col("encoding") == encoding) & (_band(F.col("len")) == band), F.lit(t)).otherwise(limit)
    random = tested.filter(F.col("p") >= limit).select("token")
    base = places.filter("kind != 'random'").drop("token", "passes")
    chosen = places.filter("kind = 'random'").join(random, "token", "left_semi").select(*base.columns)
    both = base.unionByName(chosen).withColumn("rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))
    order = Window.partitionBy("doc_id", "_t").orderBy("start", "rank")
    is_base = F.col("kind") != "random"
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    kept = both.withColumn("_b", before).withColumn("_a", after).filter(
        is_base | ~(F.coalesce(F.col("_b") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_a") < F.col("end"), F.lit(False))))
    return kept.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """One row for each document: doc_id, _t (hash of the text) and its spans."""
    found = secret_spans(docs, q).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left").select(
        "doc_id", "_t", F.coalesce("spans", F.expr("array()").cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every union of touching spans replaced by `mark`; `spans` sorted by start."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))
            .otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


def without_secrets(docs: DataFrame, q: float = Q, mark: str = "[SECRET]") -> DataFrame:
    """All rows of `docs`, with the spans found in `text` replaced by `mark` and `n_chars`, if there, counted anew."""
    found = shared(secret_spans(docs.select("doc_id", "text"), q).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "spans"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # columns of any name stay out of the way
    out = whole.join(found, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("row.text") == F.col("_u")), "left")
    changed = F.col("row").withField("text", redacted(F.col("row.text"), F.col("spans"), mark))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(redacted(F.col("row.text"), F.col("spans"), mark)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")
