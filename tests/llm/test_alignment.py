"""Token alignment against plain loops over bytes."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from clipweave.llm import alignment
from clipweave.llm.queries import QUERIES


def tokens(text):
    """[(id, start, end)] of both sides from the libraries' plain calls; empty if a side does not give the text back."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return [], []
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The fixed byte-to-character table of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def laid(pairs):
        out, at = [], 0
        for i, data in pairs:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out, b"".join(d for _, d in pairs)

    a, back_a = laid([(i, bytes(chars[c] for c in full.id_to_token(i))) for i in full.encode(" " + text, add_special_tokens=False).ids])
    b, back_b = laid(
        [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    )
    whole = (" " + text).encode()
    return (a, b) if back_a == back_b == whole else ([], [])


def brute(rows):
    """The contract by loops: groups, links that end together, corpus counts of id pairs."""
    every = {t: tokens(t) for t in {t for _, t in rows}}
    count = Counter()
    links = {}
    for t, (a, b) in every.items():
        links[t] = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if len(a) * len(b) < 2_000_000 else None
        if links[t] is None:
            ends = {y[2]: y[0] for y in b}
            links[t] = [(x[0], ends[x[2]]) for x in a if x[2] in ends]
    for _, t in rows:
        count.update(links[t])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc, t in rows:
        a, b = every[t]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for end in ends:
            part = lambda side: ",".join(str(x[0]) for x in side if lo < x[2] <= end)  # noqa: B023, E731
            groups.append(f"{part(a)}|{part(b)}")
            lo = end
        text = ";".join(groups)
        mine = links[t]
        out.append(
            (doc, len(a), len(b), len(groups), len(mine), sum(count[p] == top[p[1]] for p in mine), sum(count[p] for p in mine),
             hashlib.sha256(text.encode()).hexdigest() if text else "")
        )
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [
    (1, "Hello wide world, hello."),
    (2, None),
    (2, ""),
    (3, " "),
    (4, "<|endoftext|> and <s> </s> <unk>"),
    (None, "naïve 𝔘nicode 　 tabs\t\tand\n\nlines ﬁ é"),
    (5, "a ▁ mark that one side reads as a space"),
    (6, "Same text. Same text."),
    (6, "Same text. Same text."),
    (7, "Same text."),
    (8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (9, "x\x00y"),
]


def test_small_texts_equal_loops(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = brute(ROWS)
    assert got(alignment.agreement(df)) == want
    clash = [F.lit("x").alias(c) for c in ("a", "b", "row", "times", "groups", "links", "best")]
    assert got(alignment.agreement(df.select("*", *clash))) == want
    assert sum(r[1] == 0 for r in want) == 3  # null, empty, and the text with U+2581
    assert alignment.agreement(df.limit(0)).count() == 0


def test_query_equals_loops(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:60]  # loops over all pairs of bytes are slow
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert got(alignment.agreement(df)) == brute(short)
    found = QUERIES["op13_token_alignment"](spark, sf_dir)
    sums = found.agg(F.count("*"), F.sum("n_links"), F.sum((F.col("n_groups") != F.col("n_links")).cast("int"))).first()
    assert sums[0] == len(rows) and sums[1] > 0 and sums[2] == 0


def test_frequent_and_rare_pairs_take_both_ways(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = brute(ROWS)
    for bound in (1, 20, 10**9):
        monkeypatch.setattr(alignment, "FREQUENT", bound)
        assert got(alignment.agreement(df)) == want


def test_overlaps_are_all_pairs_that_share_bytes(spark):
    rows = [r for r in ROWS if r[0] not in (None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for doc, text in rows:
        a, b = tokens(text)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                shared = min(x[2], y[2]) - max(x[1], y[1])
                if shared > 0:
                    want.add((doc, i, j, x[0], y[0], shared, x[2] == y[2]))
    found = alignment.overlaps(df).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_long_text_and_slices(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 40)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert got(alignment.agreement(df)) == brute(ROWS)
    monkeypatch.undo()
    long = [(1, "word and Wörter, " * 30_000), (2, "x" * 100_000)]
    found = {r["doc_id"]: r for r in alignment.agreement(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    for doc, text in long:
        a, b = tokens(text)
        assert (found[doc]["n_a"], found[doc]["n_b"]) == (len(a), len(b))
        assert found[doc]["n_links"] == len({x[2] for x in a} & {y[2] for y in b})
