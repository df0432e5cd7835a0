"""Near-duplicate components by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Documents with equal shingle sets are one class. Its signature has `TREES` labels of `DEPTH` values.
2. In every tree the classes that share the first `BASE` values of their labels are one run, by a hash of that
   prefix; nothing is sorted and no common prefix is computed. Within crowded runs first links come from runs at
   greater depth. Each class is compared in one of its runs, and the links are verified and joined to components.
3. What those links did not connect: within each prefix, classes of different components meet each other, all of
   them, if their sizes and full signatures allow the similarity, and are verified as well.

Defined cases: null and empty texts have an empty set and are linked with nothing; fewer words than a
shingle are one shingle; a null id is linked with nothing (its component is null, it is kept); rows with
the same id and text are one document; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import byte_view, mix, portions, shared, shingle_hashes, sized, travels, word_hashes
from raregrain.llm.components import components

travels(__name__)

SHINGLE = 5
TREES, DEPTH, BASE = 16, 8, 4
#: Rows of a run that are compared in one piece.
PIECE = 1024


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and each text's first index (plus the end)."""
    raw, offsets = byte_view(column)
    words, first = word_hashes(raw, offsets, lower=True)
    sets, counts = [], np.zeros(len(first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            s = np.unique(shingle_hashes(words[a:b], min(size, int(b - a))))
            sets.append(s)
            counts[i] = len(s)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def _sign(flat: np.ndarray, first: np.ndarray, values: int) -> np.ndarray:
    """MinHash values (the low 16 bits of each minimum) of every non-empty set."""
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(full), values), np.uint16)
    mult, flip = _seeds(values)
    at = 0
    while at < len(full):  # pieces of about a million shingles
        end = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + (1 << 18))))
        a, b = first[full[at]], first[full[end - 1] + 1]
        x = (flat[a:b] >> np.uint64(32)).astype(np.uint32)
        starts = first[full[at:end]] - a
        buf = np.empty_like(x)
        for k in range(values):
            np.bitwise_xor(x, flip[k], out=buf)
            np.multiply(buf, mult[k], out=buf)
            low = np.minimum.reduceat(buf, starts)
            low ^= low >> np.uint32(16)
            out[at:end, k] = low * np.uint32(0x9E3779B1) >> np.uint32(16)
        at = end
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, fp (16 bytes that name the set), sig (trees x depth values of two bytes)."""
    import pyarrow as pa

    def sign(batches):
        for batch in portions(batches):
            flat, first = shingle_sets(batch.column("text"), size)
            counts = np.diff(first)
            full = np.flatnonzero(counts)
            values = _sign(flat, first, trees * depth).byteswap()  # big-endian: bytes sort like values
            fp = [None] * len(counts)
            sig = [None] * len(counts)
            if len(full):
                s1 = np.add.reduceat(mix(flat.copy()), first[full])
                s2 = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first[full])
                names = np.stack([s1 ^ mix(counts[full].astype(np.uint64)), s2], 1)
                for i, k in enumerate(full):
                    fp[k], sig[k] = names[i].tobytes(), values[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "th", "n_shingles", "fp", "sig"])

    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(sign, f"doc_id {kind}, th bigint, n_shingles bigint, fp binary, sig binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _partners(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int, slack: float):
    """For each row i, the later rows of another component (and, in a pair of blocks, of the other block) that may be similar enough."""
    values = sig.shape[1]
    for i in range(len(sig) - 1):
        rest = slice(i + 1, None)
        may = (comp[rest] != comp[i]) & (percent * np.maximum(n[rest], n[i]) <= 100 * np.minimum(n[rest], n[i])) & ((side[rest] != side[i]) | (side[i] < 0))
        j = np.flatnonzero(may) + i + 1
        if len(j):
            shared_values = (sig[j] == sig[i]).sum(1)
            good = shared_values >= (percent / 100 - slack) * values
            if good.any():
                yield i, j[good], shared_values[good]


def _groups(pdf):
    """The groups (run, lo, hi) that share a bin, one after the other."""
    if len(pdf):
        yield from (g for _, g in pdf.groupby(["run", "lo", "hi"], sort=False))


def _binned(rows: DataFrame, per_bin: int = 1000) -> DataFrame:
    """Adds `bin`: groups are dealt to bins of about `per_bin` rows, as a call for each small group would cost more than its work."""
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // per_bin + 1)
    return rows.withColumn("bin", F.pmod(F.xxhash64("run", "lo", "hi"), F.lit(bins)))


def _unpack(pdf, values: int):
    sig = np.frombuffer(b"".join(pdf["sig"]), ">u2").reshape(len(pdf), values)
    comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
    return sig, pdf["n_shingles"].to_numpy(), comp, pdf["side"].to_numpy()


def links_in(pdf, size: int, values: int, percent: int, slack: float) -> list[tuple]:
    """Verified links within one run of classes: pairs in order of likeness, each confirmed on the full sets
    unless its ends are connected already, so at most one link less than there are components."""
    import pyarrow as pa

    pdf = pdf.reset_index(drop=True)
    sig, n, comp, side = _unpack(pdf, values)
    found = [(-s, i, j) for i, js, ss in _partners(sig, n, comp, side, percent, slack) for j, s in zip(js.tolist(), ss.tolist(), strict=True)]
    found.sort()
    parent = list(range(int(comp.max()) + 1 if len(comp) else 0))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    sets: dict[int, np.ndarray] = {}

    def own(i):
        if i not in sets:
            sets[i] = shingle_sets(pa.array([pdf["text"].iat[i]], pa.string()), size)[0]
        return sets[i]
    out = []
    for _, i, j in found:
        a, b = root(comp[i]), root(comp[j])
        if a != b and _similar(own(i), own(j), percent):
            parent[a] = b
            out.append((pdf["c"].iat[i], pdf["c"].iat[j]))
    return out


def _cut(rows: DataFrame, piece: int, weight: int) -> DataFrame:
    """Adds `parts`: into how many pieces a run of `m` classes with `w` shingles is cut, and `part`, this row's."""
    parts = F.greatest(F.ceil(F.col("m") / piece), F.ceil(F.col("w") / weight)).cast("int")
    return rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))


def _grid(rows: DataFrame) -> DataFrame:
    """Every pair of pieces of a run meets in one group (side tells the two apart; -1: one piece with itself)."""
    own = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return own.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).withColumn(
        "side", F.when(F.col("lo") == F.col("hi"), -1).when(F.col("part") == F.col("lo"), 0).otherwise(1)).drop("other")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
                    base: int = BASE, piece: int = PIECE, weight: int = 1 << 21, slack: float = 0.15, longest: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document.

    `slack` is how far the share of equal signature values may lie below the similarity before a pair
    is not verified (over four and a half standard deviations with 128 values). A run of classes
    is cut into pieces of bounded rows and shingles. Where a run has more than `longest` classes (16 pieces), first
    links come from the runs at greater depth; what they leave open is compared in the grid of the run at `base`.
    """
    values = trees * depth
    sigs = shared(signatures(docs, size, trees, depth))
    known = sigs.filter("fp is not null and doc_id is not null")
    # one row per distinct set, represented by its lowest id
    nodes = shared(known.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
                   .select("fp", F.col("r.doc_id").alias("c"), F.col("r.th").alias("th"), "n_shingles", "sig"))
    longest = 16 * piece if longest is None else longest
    runs = shared(_runs(nodes, trees, depth, base, longest))
    texts = docs.select(F.col("doc_id").alias("c"), F.xxhash64("text").alias("th"), "text")
    kind = dict(nodes.dtypes)["c"]
    members = nodes.select("c", "th", "n_shingles", "sig")

    # rows that repeat an id and its text must meet their group once; most tables have none
    repeats = known.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0

    def links(pdf):
        import pandas as pd

        found = [x for g in _groups(pdf) for x in links_in(g, size, values, percent, slack)]
        return pd.DataFrame(found, columns=["u", "v"]).astype({"u": pdf["c"].dtype, "v": pdf["c"].dtype})

    def verified(rows: DataFrame) -> DataFrame:
        """`rows`: c, comp, run, lo, hi, side. The texts of just these classes go to their groups; which texts
        these are is broadcast within a bound, so that the others do not move."""
        wanted = _binned(rows).join(members, "c")
        asked = shared(rows.select("c").distinct().join(nodes.select("c", "th"), "c"))
        bodies = texts.join(sized(asked, most=500_000), ["c", "th"], "left_semi")
        bodies = bodies.dropDuplicates(["c", "th"]) if repeats else bodies
        return shared(wanted.join(bodies, ["c", "th"]).select("bin", "run", "lo", "hi", "side", "c", "comp", "n_shingles", "sig", "text")
                      .groupBy("bin").applyInPandas(links, f"u {kind}, v {kind}"))

    # first links: each class in the longest of its runs that are not crowded (or the shortest crowded one), cut into
    # pieces that share the run's lowest class
    fits = F.when(F.col("m") <= longest, F.col("m")).otherwise(-F.col("m")).alias("fits")
    home = runs.groupBy("c").agg(F.max(F.struct(fits, "run", "m", "w", "first")).alias("r")).select("c", "r.*")
    pieces = _cut(home, piece, weight)
    hubs = pieces.filter("parts > 1").groupBy("run", "part").agg(F.first("first").alias("c")).select("run", "part", "c")
    rows = pieces.select("run", "part", "c").unionByName(hubs).distinct()
    first = verified(shared(rows.select("run", F.col("part").alias("lo"), F.col("part").alias("hi"), F.lit(-1).alias("side"), "c", F.col("c").alias("comp"))))
    comp = shared(components(first))

    # what is left: runs at `base`, crowded or not, that still hold more than one component (deeper ones lie within them)
    whole = runs.filter("at_base")
    placed = shared(whole.join(comp, whole["c"] == comp["node"], "left").select(whole["*"], F.coalesce("component", "c").alias("comp")))
    mixed = placed.groupBy("run").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("run")
    open_rows = shared(_grid(_cut(placed.join(mixed, "run", "left_semi"), piece, weight)).select("run", "lo", "hi", "side", "c", "comp"))

    def promising(pdf):
        import pandas as pd

        parts = [pdf.iloc[:0]]
        for g in _groups(pdf):
            sig, n, comp_, side = _unpack(g, values)
            hit = np.zeros(len(g), bool)
            for i, js, _ in _partners(sig, n, comp_, side, percent, slack):
                hit[i] = True
                hit[js] = True
            if hit.any():
                parts.append(g.loc[hit])
        return pd.concat(parts)[["run", "lo", "hi", "side", "c", "comp"]]

    likely = shared(_binned(open_rows).join(nodes.select("c", "n_shingles", "sig"), "c").groupBy("bin").applyInPandas(
        promising, f"run bigint, lo int, hi int, side int, c {kind}, comp {kind}"))
    second = verified(likely)
    every = shared(components(first.unionByName(second)))
    found = nodes.join(every, nodes["c"] == every["node"], "left").select("fp", F.coalesce("component", "c").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "fp").join(found, "fp", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _runs(nodes: DataFrame, trees: int, depth: int, base: int, longest: int) -> DataFrame:
    """run (number of a tree's prefix), c, m (classes in the run), w (their shingles), first (lowest class), at_base: runs of two or more.

    Every run of `base` values is kept, whatever its size. Under one of more than `longest` classes come the runs
    one value deeper, until they are short enough or the label ends: a crowded region's likeliest partners.
    """
    def cut(rows: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
        keyed = rows.withColumn("run", F.xxhash64("tree", F.substring("label", 1, 2 * at))).select("tree", "label", "run", "c", "n")
        sizes = keyed.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min("c").alias("first")).filter("m > 1")
        return keyed, sizes

    labels = nodes.select(F.posexplode(F.array(*[F.substring("sig", 2 * depth * t + 1, 2 * depth) for t in range(trees)])).alias("tree", "label"),
                          "c", F.col("n_shingles").alias("n"))
    out, rows = None, labels
    for at in range(base, depth + 1):
        keyed, sizes = cut(rows, at)
        sizes = shared(sizes)
        crowded = at < depth and sizes.filter(F.col("m") > longest).limit(1).count() > 0
        done = keyed.join(sizes.filter(F.col("m") <= longest) if crowded and at > base else sizes, "run").select("run", "c", "m", "w", "first", F.lit(at == base).alias("at_base"))
        out = done if out is None else out.unionByName(done)
        if not crowded:
            break
        rows = shared(keyed.join(sizes.filter(F.col("m") > longest).select("run"), "run", "left_semi"))
    return out


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that stay when one document of each near-duplicate group does; of rows with one id, one stays.

    Texts do not move: the ids to drop are broadcast within a bound, and joined by id beyond it.
    """
    found = shared(near_duplicates(docs.select("doc_id", "text"), **how))
    drop = found.filter("not kept").select("doc_id").distinct()
    kept = docs.join(sized(drop, most=500_000), "doc_id", "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = again.count()
    if not n:
        return kept
    again = sized(again, n)
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
