"""The queries of the subpackage: against their SQL where there is one, else
against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from modengine.llm import chat_tree, queries

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.compare(spark, DATA, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def plain_fingerprint(text: str) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict) -> dict:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    prints = {i: plain_fingerprint(t) for i, t in documents(spark).items()}
    groups = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op2_simhash_dedup"](spark, DATA).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_packing(spark):
    texts = documents(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = queries.QUERIES["op7_packing"](spark, DATA).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for found, end in [(p, len(ids[i])) for i, p in pieces.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert end in (None, at) and (end is not None or at <= 2048)
    total = sum(map(len, ids.values()))
    assert 2048 * len(windows) - total < 2048


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries._TRICKY), (-1, 1, "assistant", queries._TRICKY)]
    said = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        said[conv].append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in said.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (
            len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned),
            sum(len(chat_tree.render(r, t)[0]) for r, t in turns),
        )
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op8_chat_tree"](spark, DATA).collect()} == want


def test_sharding(spark):
    texts = documents(spark)
    rows = queries.QUERIES["op10_sharding"](spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by_shard[r["shard"]].append(r["slot"])
        by_text[raw].add(r["shard"])
    assert set(by_shard) == set(range(16))
    counts = [len(s) for s in by_shard.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_classifier(spark):
    """Held-out accuracy: judged documents that learning did not see."""
    from modengine.llm import quality_classifier

    d = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.score_documents(docs, labels.filter("doc_id % 4 <> 0")).select("doc_id", "kept")
    rows = scored.join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    right = np.mean([r["kept"] == bool(r["quality"]) for r in rows])
    clean = np.mean([r["kept"] for r in rows if r["quality"]])
    assert len(rows) > 80 and right > 0.9 and clean > 0.93
