import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.packing import Encoder, Packer, documents_packed, pack, sequences, tokenise


def test_ids_are_the_tokenizers(odd_rows):
    exact, mine = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Encoder()
    texts = [t for _, t, *_ in odd_rows if t is not None] + ["it's 12,345 — ok!\n\n  tabs\t", "日本語 текст 🎉", "a\x00b", " "]
    for t in texts:
        assert mine.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def check_rows(rows, docs):
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for k, t in docs:
        x = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
        ids.setdefault(k, []).append([(i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
    want = sorted((str(k), *p) for k, many in ids.items() for pieces in many for p in pieces)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r["length"] for r in rows)


def test_contract_on_odd_rows(odd, odd_rows):
    n, total = check_rows(documents_packed(odd).collect(), [(k, t) for k, t, *_ in odd_rows])
    assert n == -(-total // 2048)


def test_runs_of_white_space(spark):
    rows = [(i, "a" + c * 2_000_000 + "b") for i, c in enumerate(" \n\t\u00a0")] + [(9, "a" + " \n\t" * 400_000)]
    check_rows(documents_packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_clashing_columns_are_refused(odd):
    with pytest.raises(ValueError, match="already columns"):
        tokenise(odd)
    with pytest.raises(ValueError, match="reserved"):
        pack(odd.select(F.lit(1).alias("length"), F.lit(1).alias("offset")))


def test_empty_table(none):
    assert documents_packed(none).count() == 0


def test_many_tasks_lose_nothing(spark):
    rows = spark.range(0, 20_000, 1, 40).select("id", (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    out = pack(rows).toPandas()
    assert len(out) == 20_000 and out.id.is_unique
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= 1.002 * -(-out.length.sum() // 2048)


def test_sequences_hold_the_ids(spark, odd):
    pieces = tokenise(odd.where("length(text) < 3000").select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    placed = pack(pieces.drop("ids")).join(pieces.select("row", "ids"), "row")
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in sequences(placed).collect()}
    for r in placed.collect():
        assert (whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()


@pytest.mark.parametrize("most_open", [1, 4, 64])
def test_best_fit_against_a_plain_version(most_open):
    r = random.Random(most_open)
    items = [r.randint(1, 100) for _ in range(500)]
    p = Packer(100, most_open)
    closed = [x for i, n in enumerate(items) for x in p.place(i, n)]
    assert p.open <= most_open
    closed += list(p.finish())
    bins, done = [], []  # plain: [free, items]
    for i, n in enumerate(items):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            free = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == free][-1]
            bins.remove(b)
        else:
            if len(bins) == most_open:
                full = [b for b in bins if b[0] == min(x[0] for x in bins)][-1]
                bins.remove(full)
                done.append(full)
            b = [100, []]
        b[1].append(i)
        b[0] -= n
        (bins if b[0] else done).append(b)
    assert sorted(sorted(i for i, _ in x[3]) for x in closed) == sorted(sorted(b[1]) for b in done + bins)
    assert packing.CAPACITY == 2048
