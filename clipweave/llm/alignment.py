"""Alignment of two tokenizers' tokens over the same text, and how well their ids agree over a corpus."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.common import keep

A_FILES, B_FILE = "byte_bpe_50k", "piece_bpe_32k.model"
#: UTF-8 bytes of texts that are aligned at once; a longer text is one piece of work.
SLICE = 1 << 20
#: A pair of ids is frequent if it holds more than 1 / FREQUENT of all rows, so there are fewer than FREQUENT.
FREQUENT = 10_000


class Side(NamedTuple):
    """A vocabulary: how to encode texts, the bytes of each id, and their lengths."""

    encode: object
    pieces: list[bytes]
    sizes: np.ndarray


def _side(encode, pieces: list[bytes]) -> Side:
    return Side(encode, pieces, np.array([len(p) for p in pieces], np.int64))


@functools.lru_cache(maxsize=2)
def sides(folder: str | None = None) -> tuple[Side, Side]:
    """The byte-level vocabulary (A) and the piece vocabulary with byte fallback (B), once in each worker.

    ``folder`` names the place of the vocabulary files; None: that of ``public_tokenizers``.
    """
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    place = public_tokenizers.path if folder is None else lambda f: f"{folder}/{f}"
    with open(place(f"{A_FILES}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(A_FILES, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(place(f"{A_FILES}.json"))
    full.encode_special_tokens = True  # the strings of special tokens are plain text

    def encode_a(texts: list[str]) -> list:
        out = []
        for text in texts:
            try:
                out.append(fast.encode_to_numpy(" " + text, disallowed_special=()))
            except ValueError:  # a text that its pattern engine cannot handle
                out.append(full.encode(" " + text, add_special_tokens=False).ids)
        return out

    a = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        a[rank] = piece
    model = sentencepiece.SentencePieceProcessor(model_file=place(B_FILE))
    name = model.id_to_piece
    b = [
        bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]
    return _side(encode_a, a), _side(lambda texts: model.encode(texts, num_threads=1), b)


class Aligned(NamedTuple):
    """Tokens of some texts laid end to end, and their overlaps, ordered by text and position."""

    doc_a: np.ndarray  # text number of each A token
    doc_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    overlaps: pd.DataFrame  # a, b: token numbers; ends_together; start, end: shared bytes


def _frame(ids: list, side: Side, base: np.ndarray, mark: str) -> pd.DataFrame:
    """Tokens as doc, id, number, first byte and end, both counted over all texts."""
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
    ends = np.cumsum(side.sizes[flat])
    doc = np.repeat(np.arange(len(ids)), counts)
    assert len(ends) == 0 or ends[-1] == base[-1]
    starts = ends - side.sizes[flat]
    return pd.DataFrame({"doc": doc, "start": starts, mark: np.arange(len(flat)), f"id_{mark}": flat, f"end_{mark}": ends})


def align_texts(texts: list[str | None], folder: str | None = None) -> Aligned:
    """Tokens of each text under both vocabularies and all pairs whose bytes overlap.

    Each token finds the other side's token that covers its first byte (``merge_asof`` by document); of two
    tokens that overlap, the later start lies in the other, so both directions give all overlaps.  Texts
    that are null or empty, or that a vocabulary does not give back byte by byte, have no tokens.
    """
    a, b = sides(folder)
    whole = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    some = [i for i, w in enumerate(whole) if w]
    ids_a: list = [()] * len(texts)
    ids_b: list = [()] * len(texts)
    for i, x, y in zip(some, a.encode([texts[i] for i in some]), b.encode([texts[i] for i in some])):
        back = b"".join(map(a.pieces.__getitem__, x)), b"".join(map(b.pieces.__getitem__, y))
        if back == (whole[i], whole[i]):
            ids_a[i], ids_b[i] = x, y
        else:
            whole[i] = b""
    base = np.cumsum([len(w) for w in whole])
    left, right = _frame(ids_a, a, base, "a"), _frame(ids_b, b, base, "b")
    ahead = pd.merge_asof(left, right, on="start", by="doc")
    back = pd.merge_asof(right, left.assign(start_a=left["start"]), on="start", by="doc")
    back = back[back["start_a"] != back["start"]]  # equal starts were found from the other side
    # Every overlap begins at another byte, in the order of its tokens.
    both = pd.concat([ahead[["a", "b", "start", "end_a", "end_b"]], back[["a", "b", "start", "end_a", "end_b"]]], ignore_index=True)
    both = both.take(np.argsort(both["start"].to_numpy(), kind="stable"))
    ends = both[["end_a", "end_b"]].min(axis=1)
    overlaps = pd.DataFrame(
        {"a": both["a"], "b": both["b"], "ends_together": both["end_a"] == both["end_b"], "start": both["start"], "end": ends}
    )
    return Aligned(*(x.to_numpy() for x in (left["doc"], right["doc"], left["id_a"], right["id_b"])), overlaps)


@functools.lru_cache(maxsize=2)
def _written(folder: str | None) -> tuple[np.ndarray, ...]:
    """Each id as text with what follows it: for A a comma or a bar, for B a comma or a semicolon."""
    size = max(len(s.pieces) for s in sides(folder))
    return tuple(np.array([f"{i}{end}" for i in range(size)], object) for end in (",", "|", ";"))


def _digest(found: Aligned, n: int, folder: str | None) -> Iterator[tuple]:
    """For each text: tokens of A and B, groups, the groups as text, id pairs of links and how often each occurs."""
    links = found.overlaps[found.overlaps["ends_together"].to_numpy()]
    la, lb = links["a"].to_numpy(), links["b"].to_numpy()
    end_a, end_b = np.zeros(len(found.ids_a), bool), np.zeros(len(found.ids_b), bool)
    end_a[la], end_b[lb] = True, True
    # Group of a token: the number of groups closed before it.  A group writes its A tokens, then its B tokens.
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    until_b = np.concatenate([[0], lb + 1])
    at_a = np.arange(len(found.ids_a)) + until_b[group_a]
    at_b = np.arange(len(found.ids_b)) + (la[group_b] + 1 if len(la) else 0)
    comma, bar, semicolon = _written(folder)
    words = np.empty(len(at_a) + len(at_b), object)
    words[at_a] = np.where(end_a, bar[found.ids_a], comma[found.ids_a])
    words[at_b] = np.where(end_b, semicolon[found.ids_b], comma[found.ids_b])

    n_a, n_b = np.bincount(found.doc_a, minlength=n), np.bincount(found.doc_b, minlength=n)
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
    width_a, width_b = (len(s.pieces) for s in sides(folder))
    doc = found.doc_a[la]
    pair, times = np.unique((doc * width_a + found.ids_a[la]) * width_b + found.ids_b[lb], return_counts=True)
    pair_doc, pair = np.divmod(pair, width_a * width_b)
    pair_a, pair_b = np.divmod(pair, width_b)
    pair_cuts = np.searchsorted(pair_doc, np.arange(n + 1))
    groups = np.bincount(doc, minlength=n)
    for i in range(n):
        lo, hi = pair_cuts[i], pair_cuts[i + 1]
        text = "".join(words[cuts[i] : cuts[i + 1]].tolist())[:-1]
        yield int(n_a[i]), int(n_b[i]), int(groups[i]), text, pair_a[lo:hi], pair_b[lo:hi], times[lo:hi]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE`` characters."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def align(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Groups and links of two tokenizers for each row of ``docs (doc_id, text)``, in one map pass.

    Byte offsets where tokens of both end cut them into groups; a link is a pair of tokens that end together.
    Whole texts are encoded once; a task holds about 1 MB of texts and their tokens, or one longer text.

    Null or empty texts and texts that a vocabulary does not give back have no tokens.  Null and
    repeated ids are kept, row by row.  Other columns are ignored.  No rows: no rows.

    Returns doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), and the distinct id pairs of the links
    as arrays a, b, with times.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                rows = list(_digest(align_texts(texts[lo:hi], folder), hi - lo, folder))
                n_a, n_b, groups, text, a, b, times = (list(c) for c in zip(*rows))
                long, small = pa.int64(), pa.int32()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *[pa.array(c, long) for c in (n_a, n_b, groups)], pa.array(text, pa.string())]
                    + [_lists(c, small) for c in (a, b, times)],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups", "a", "b", "times"],
                )

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def overlaps(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Every pair of tokens of a text whose bytes overlap; texts without tokens give no rows.

    Returns doc_id, token_a, token_b (from 0 in the text), id_a, id_b, bytes (shared), ends_together.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                got = align_texts(texts[lo:hi], folder)
                a, b = got.overlaps["a"].to_numpy(), got.overlaps["b"].to_numpy()
                doc = got.doc_a[a]
                first_a = np.searchsorted(got.doc_a, np.arange(hi - lo))[doc]
                first_b = np.searchsorted(got.doc_b, np.arange(hi - lo))[doc]
                shared = (got.overlaps["end"] - got.overlaps["start"]).to_numpy()
                numbers = [a - first_a, b - first_b, got.ids_a[a], got.ids_b[b], shared]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in numbers]]
                    + [pa.array(got.overlaps["ends_together"].to_numpy())],
                    ["doc_id", "token_a", "token_b", "id_a", "id_b", "bytes", "ends_together"],
                )

    schema = "doc_id long, token_a long, token_b long, id_a long, id_b long, bytes long, ends_together boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def agreement(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``align`` for each document, and how its links rank among the links of the whole corpus.

    Links are summed to distinct pairs inside each document, then over the corpus.  The pairs that hold more than
    1/10,000 of these rows (fewer than 10,000, so they may be broadcast) are looked up without a
    shuffle; the others are joined by pair, where no key holds more than that share.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is as frequent as the most frequent one of
    its B id), count_sum (the corpus counts of its links, summed), groups_sha256 ('' without tokens).
    """
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    each = keep(
        align(docs, folder).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", sha.alias("groups_sha256"), "a", "b", "times"
        ),
        "aligned",
    )
    pairs = each.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    sums = pairs.groupBy("a", "b").agg(F.sum("times").cast("long").alias("links"), F.count(F.lit(1)).alias("rows"))
    sums = keep(sums, "pairs")
    ranked = sums.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    ranked = keep(ranked, "ranked")
    often = ranked.where(F.col("rows") * FREQUENT > total).select("a", "b", "links", "best")
    seldom = ranked.where(F.col("rows") * FREQUENT <= total).select("a", "b", "links", "best")

    scored = lambda df: df.groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    looked = pairs.join(F.broadcast(often), ["a", "b"], "left")
    others = looked.where("links is null").select("row", "a", "b", "times").join(seldom, ["a", "b"])
    parts = scored(looked.where("links is not null")).union(scored(others))
    whole = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return each.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(whole, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", number("n_links"), number("n_best"), number("count_sum"), "groups_sha256"
    )
