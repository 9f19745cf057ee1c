"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import keep, runs
from clipweave.llm.components import components, merged
from clipweave.llm.shingles import shingle_sets

REGISTERS = 512
MANTISSA = 9
#: Marks a register that is empty and borrows its value.
BORROWED = 1 << 15
BANDS, BAND_ROWS = 32, 5
SIGMAS = 5.0
_RANDOM = np.random.default_rng(20170313)
#: Registers in the order in which they are stored: bands first.
_ORDER = _RANDOM.permutation(REGISTERS)
#: Which occupied register lends its value to an empty one: the one ranked highest.
_LENDER = np.stack([_RANDOM.permutation(REGISTERS) for _ in range(REGISTERS)])
_SIGNATURE = "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary"


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros and mantissa) of sorted hashes.

    The top 9 bits of a hash choose the register; the smallest remainder there is kept as its
    count of leading zeros and the bits after the first one.  An empty register of a band borrows
    from the filled register that ranks highest in its own fixed order (densification), so that
    bands of short texts stay as selective as those of long ones.
    """
    bucket = (shingles >> np.uint64(55)).astype(np.intp)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled = bucket[first]
    rest = (shingles[first] << np.uint64(9)) >> np.uint64(11)  # 53 bits: exact as a double
    exponent = np.frexp(rest.astype(np.float64))[1]
    up = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    down = np.maximum(MANTISSA + 1 - exponent, 0).astype(np.uint64)
    mantissa = ((rest >> up) << down) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(REGISTERS, BORROWED, np.uint16)
    out[filled] = ((53 - exponent) << MANTISSA) | mantissa.astype(np.int64)
    if len(filled) < REGISTERS:
        banded = _ORDER[: BANDS * BAND_ROWS]
        empty = banded[out[banded] == BORROWED]
        out[empty] = out[filled[_LENDER[np.ix_(empty, filled)].argmax(1)]] | BORROWED
    return out[_ORDER]


def estimate(
    a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of signature rows, and how low one may fall for a pair at ``similarity``.

    Of the registers that either set fills, the share that both fill alike estimates Jaccard.
    It is corrected for registers that agree by chance: two minima of sets of size n and m fall
    into one cell of the (zeros, mantissa) grid with probability about
    ln 2 / 2**mantissa * n m / (n + m)**2.  The filled registers sample the union without
    repetition, so the deviation shrinks as they near its size: small sets are almost read off.
    """
    own = (a | b) & BORROWED == 0
    either = (a & b) & BORROWED == 0
    seen = np.maximum(either.sum(-1), 1).astype(np.float64)
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    chance = np.log(2) / (1 << MANTISSA) * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    found = np.clip((((a == b) & own).sum(-1) / seen - chance) / (1 - chance), 0, 1)
    union = np.maximum((n_a + n_b) / (1 + similarity), seen)
    unseen = 1 - (seen - 1) / np.maximum(union - 1, 1)
    deviation = np.sqrt(similarity * (1 - similarity) / seen * np.maximum(unseen, 0))
    return found, similarity - SIGMAS * deviation - 1 / seen


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: set size, fingerprint of the whole set, registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for found in shingle_sets(batch.column(1), words):
                if len(found):
                    mark = xxhash.xxh3_128_digest(found.tobytes())
                    one = (len(found), *np.frombuffer(mark, np.int64).tolist(), registers(found).tobytes())
                else:
                    one = (0, 0, 0, None)
                for column, x in zip(rows, one):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(r, t) for r, t in zip(rows, types)]],
                ["doc_id", "n_shingles", "fp_a", "fp_b", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, _SIGNATURE)


def _sigs(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, REGISTERS)


def _sizes_fit(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the estimate cannot rule out."""
    side = lambda s: sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "sig")])
    joined = pairs.join(side("a"), pairs["a"] == F.col("rep_a")).join(side("b"), pairs["b"] == F.col("rep_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows == 0:
                continue
            n_a, n_b = t.column("n_a").to_numpy(), t.column("n_b").to_numpy()
            est, low = estimate(_sigs(t, "sig_a"), _sigs(t, "sig_b"), n_a, n_b, percent / 100)
            ok = (est >= low) & _sizes_fit(n_a, n_b, percent)
            yield from t.select(["a", "b"]).filter(pa.array(ok)).to_batches()

    columns = ["a", "b", "n_a", "n_b", "sig_a", "sig_b"]
    return joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select(*columns).mapInArrow(
        test, "a long, b long"
    )


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, part_rows: int = 256) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full shingle sets satisfy 100 * common >= percent * union.

    The partners of one ``a`` are dealt to parts of about ``part_rows``; each part gets the text of
    ``a`` once.  So a hub spreads over tasks and a task holds one set of a hub at a time.
    """
    pairs = keep(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    dealt = keep(dealt, "dealt")
    wanted = dealt.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("role")).union(
        dealt.select("a", "part", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # Texts are shuffled at every size: what is wanted grows with the input and is no broadcast.
    rows = texts.join(wanted.hint("merge"), "id").repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            get = lambda c: batch.column(names.index(c))  # noqa: E731, B023
            a, part, role, ids = (get(c).to_numpy() for c in ("a", "part", "role", "id"))
            out_a, out_b = [], []
            for i, found in enumerate(shingle_sets(get("text"), words)):
                if role[i] == 0:
                    held, own = (a[i], part[i]), found
                    continue
                if held != (a[i], part[i]):  # its hub's text is gone
                    continue
                both = np.concatenate([own, found])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    out_a.append(a[i])
                    out_b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.select("a", "part", "role", "id", "text").mapInArrow(compare, "a long, b long").distinct()


_BLOCK = ["index", "band", "i", "j"]


def _mixed(members: DataFrame, percent: int) -> DataFrame:
    """Members of band buckets that may have a partner there: of another component and of a fitting size.

    Sizes of linked sets differ by at most 100 / percent, so they lie in the same or in neighbouring classes of
    a slightly wider ratio; a member whose three classes hold one component only has no partner.  Of buckets
    with equal members the one of the first band is kept: a pair is looked at in the first band it shares.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.01)).cast("int")
    members = members.withColumn("size", size)
    part = members.groupBy("index", "band", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    around = part.select("index", "band", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("size"), "lo", "hi")
    open_ = around.groupBy("index", "band", "size").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    left = members.join(open_.select("index", "band", "size"), ["index", "band", "size"])
    marks = left.groupBy("index", "band").agg(
        F.count(F.lit(1)).alias("c"),
        *[F.sum(F.xxhash64(F.lit(k), "rep").cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)],
    )
    once = marks.groupBy("c", "h0", "h1").agg(F.min(F.struct("index", "band")).alias("_b")).select("_b.*")
    return left.join(once, ["index", "band"]).select("rep", "index", "band", "n", "component")


def _blocks(members: DataFrame, chunk: int) -> DataFrame:
    """Members of a band bucket dealt to chunks; every two chunks of a bucket meet in one block (i, j).

    A bucket has a chunk for every ``chunk`` members and for every ``chunk`` * 2,048 shingles, so a block is
    bounded in rows and, but for single very long texts, in bytes.
    """
    count, size = F.count(F.lit(1)) / chunk, F.sum("n") / (chunk * 2048)
    sized = members.groupBy("index", "band").agg(F.ceil(F.greatest(count, size)).cast("int").alias("chunks"))
    dealt = members.join(sized, ["index", "band"]).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "index", "band", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "rep", "component", "n"
    )


def _near(k: int, index: int, i: int, j: int, c, comp, n, sig: np.ndarray, percent: int) -> np.ndarray:
    """Later rows of a block that row ``k`` may be linked with: of another component, and not ruled out.

    A pair that shares several bands is looked at in the first of them.
    """
    rest = np.arange(k + 1, len(n))
    rest = rest[(comp[rest] != comp[k]) & _sizes_fit(n[k], n[rest], percent)]
    if i != j:
        rest = rest[(c[rest] == j) & (c[k] == i)]
    if not len(rest):
        return rest
    est, low = estimate(sig[k], sig[rest], n[k : k + 1], n[rest], percent / 100)
    near = rest[est >= low]
    banded = lambda rows: rows[..., : BANDS * BAND_ROWS].reshape(*rows.shape[:-1], BANDS, BAND_ROWS)
    return near[(banded(sig[k]) == banded(sig[near])).all(-1).argmax(-1) == index]


def _cross_links(
    members: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int, chunk: int
) -> DataFrame:
    """Links between different components inside band buckets, enough of them to join what is linked.

    Blocks are first compared by signatures; only their members with a possible partner go on.
    Those get their text once per block and are compared on full sets there.  So rows grow with the
    members, never with the pairs, and no pair leaves a block but a link that joins two components.
    """
    blocks = _blocks(members, chunk)
    order = [*_BLOCK, "c", "rep"]
    rows = blocks.join(sets.select("rep", "sig"), "rep").repartition(*_BLOCK).sortWithinPartitions(*order)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (index, band, i, j), t in runs(batches, _BLOCK):
            comp, n, c = (t.column(x).to_numpy() for x in ("component", "n", "c"))
            sig = _sigs(t, "sig")
            wanted = np.zeros(len(n), bool)
            for k in range(len(n) - 1):
                near = _near(k, index, i, j, c, comp, n, sig, percent)
                wanted[near] = True
                wanted[k] |= len(near) > 0
            if wanted.any():
                yield from t.select([*order, "component", "n"]).filter(pa.array(wanted)).to_batches()

    columns = "index int, band long, i int, j int, c int, rep long, component long, n long"
    active = keep(rows.select(*order, "component", "n", "sig").mapInArrow(candidates, columns), "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    # Texts are shuffled at every size: what is wanted grows with the input and is no broadcast.
    # A repeated id brings its other texts too; the right one has the size of the set and is checked by it.
    full = texts.join(active.hint("merge"), "rep").repartition(*_BLOCK).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (index, _, i, j), t in runs(batches, _BLOCK):
            rep, comp, n, c = (t.column(x).to_numpy() for x in ("rep", "component", "n", "c"))
            comp = comp.copy()
            found = list(shingle_sets(t.column("text").combine_chunks(), words))
            sig = np.stack([registers(s) if len(s) == m else np.full(REGISTERS, BORROWED, np.uint16) for s, m in zip(found, n)])
            links = []
            for k in range(len(rep) - 1):
                for m in _near(k, index, i, j, c, comp, n, sig, percent).tolist():
                    if comp[k] == comp[m] or len(found[k]) != n[k] or len(found[m]) != n[m]:
                        continue
                    both = np.concatenate([found[k], found[m]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        links.append((rep[k], rep[m]))
                        comp[comp == comp[m]] = comp[k]  # from now on they are connected
            if links:
                lo, hi = np.sort(np.array(links), axis=1).T
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    return full.select(*order, "component", "n", "text").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = 1024
) -> DataFrame:
    """Group documents whose sets of ``words``-word shingles have a Jaccard similarity of percent/100 or more.

    1. Every text becomes 512 HyperMinHash registers of 16 bits.  Equal sets meet by a 128-bit
       fingerprint; only the smallest id of each goes on, so copies are never paired.
    2. 32 bands of 5 registers: a pair at 0.8 meets in at least one with probability 1 - 3e-6.
    3. Each member of a band bucket is paired with the bucket's smallest id (a star, not all pairs).
       Pairs whose corrected estimate lies 5 deviations and a register below the threshold go;
       the others are confirmed on full sets; components follow.
    4. Buckets that still hold several components are compared fully, in blocks of ``chunk``
       members: by signatures, then on full sets.  So a star through a wrong centre loses no link, and a
       family of similar texts that are not linked costs rows for its members, not for its pairs.
    Sets are compared as sets of 64-bit hashes of shingles; "full" and "exact" hold up to their collisions.

    A-Z count as a-z; words end at ASCII white space.  Fewer words than ``words``: the whole
    sequence is one shingle.  Null text or text without words: size 0, alone, kept.  Repeated
    rows: equal results.  A row with a null id belongs to the component of the documents with an id
    and the same set, not kept; without such a document it is alone: component null, kept.  Empty
    input: no rows.  Other columns are ignored.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept.
    """
    signed = keep(signatures(docs, words), "signed")
    some = signed.where("n_shingles > 0")
    row = F.struct("doc_id", "n_shingles", "sig")
    firsts = some.where("doc_id is not null").groupBy("fp_a", "fp_b").agg(F.min(row).alias("r"))
    sets = keep(
        firsts.select(
            "fp_a", "fp_b", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), "r.sig"
        ),
        "sets",
    )
    width = 2 * BAND_ROWS
    band = lambda i: F.xxhash64(i, F.expr("sig").substr(i * width + 1, F.lit(width)))
    every = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)
    bands = sets.select("rep", "n", F.posexplode(every).alias("index", "band"))
    leads = bands.groupBy("index", "band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    multi = keep(bands.join(leads.select("index", "band", "lead"), ["index", "band"]), "multi")
    lean = sets.select("rep", "n", "sig")

    stars = multi.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tried = keep(_estimated(stars, lean, percent), "tried")
    links = keep(confirmed(tried, docs, words, percent), "links")
    first = keep(components(links), "first")

    member = multi.select("rep", "index", "band", "n").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    mixed = keep(_mixed(member.withColumn("component", F.coalesce("component", "rep")), percent), "mixed")
    more = keep(_cross_links(mixed, lean, docs, words, percent, chunk), "more")
    final = merged(first, more) if more.limit(1).count() else first

    named = sets.select("fp_a", "fp_b", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = keep(named.select("fp_a", "fp_b", F.coalesce("component", "rep").alias("component")), "named")
    joined = some.select("doc_id", "n_shingles", "fp_a", "fp_b").join(named, ["fp_a", "fp_b"], "left")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    both = joined.select("doc_id", "n_shingles", "component").union(alone)
    return both.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"),
    )
