"""Operators with one right answer, against plain versions."""

from __future__ import annotations

import array
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from kpiweave.llm import automata, common, decontaminate, merkle, near_copies, pieces, queries, secrets, shards, token_files
from tests.llm.conftest import LINES
from tools.check_queries import compare, oracle
from kpiweave.workload import Entry

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    entry = Entry(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], "")
    assert compare(spark, oracle(data), name, entry, data) is None


# ---- secrets

def plain_spans(text: str):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, rule in enumerate(secrets.MORE_RULES, 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.head + rule.body, text)]
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_secrets_in_random_texts():
    dice = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "=", ":", " ", '"', "'", "abc", "ABCDEF123", "AKIA", "0123456789abcdef", "é",
            "漢", "\n", "AKIA" + "Z9" * 9, "f" * 30, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-", "eyJ" + "a" * 9 + "."]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randint(0, 14))) for _ in range(4000)]
    texts += ["", "f" * 9000 + "token=" + "x" * 3000, "é" * 1023 + "secret: abcdefgh", "a" * 5000]
    found = secrets.Scan().texts([t.encode() for t in texts])
    assert [found.get(i, []) for i in range(len(texts))] == [plain_spans(t) for t in texts]


def test_automaton_is_minimal_and_blocks_change_nothing():
    scanner = automata.compile_rules(["ab+c", "b{2,3}"], anywhere=True)
    data = np.frombuffer(b"xabbbcabbc" * 500, np.uint8)
    ends = np.array([10, 10, 3000, 5000])
    for leftward in (False, True):
        whole = automata.states_after(scanner, data, ends, leftward=leftward, block=1 << 20)
        assert (whole == automata.states_after(scanner, data, ends, leftward=leftward, block=7)).all()
    rows = {(tuple(r), a) for r, a in zip(scanner.step.reshape(-1, scanner.width).tolist(), scanner.accepts.tolist(), strict=True)}
    assert len(rows) == scanner.states


def test_secrets_of_odd_rows(odd_docs, no_docs):
    got = secrets.find_secrets(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["spans"] == [] for r in got)
    assert secrets.find_secrets(no_docs).count() == 0
    row = odd_docs.limit(1).withColumn("text", F.lit("é token=abcdef0 x"))
    found = secrets.find_secrets(row)
    assert found.select(secrets.masked(F.col("text"), F.col("spans"))).first()[0] == "é [assign] x"


# ---- tokens

def test_pieces_like_the_library(odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    dice = random.Random(1)
    bits = [*"ab  \n\t▁.éü漢😀 \x00'!", "ing", "the", " the", "  "]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randint(0, 12))) for _ in range(5000)]
    table = pieces.ChunkTable(sp)
    assert not table.whole
    assert [np.frombuffer(x, "<i4").tolist() for x in table.encode(texts)] == sp.encode(texts)
    table.whole, table.ids = True, {}
    assert [np.frombuffer(x, "<i4").tolist() for x in table.encode(texts[:50])] == sp.encode(texts[:50])
    for row in pieces.decode_ids(pieces.encode_texts(odd_docs, PIECES), PIECES).collect():
        assert row["ids"] == sp.encode(row["text"] or "") and row["decoded"] == sp.decode(row["ids"])
    assert pieces.encode_texts(no_docs, PIECES).count() == 0


def test_token_parts_like_the_library():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    table = token_files.PieceTable(tokenizer.to_str(), "H")
    dice = random.Random(2)
    bits = [*"ab  \n\t.éü漢😀 \x00'! \x1c　\xa0\x85", "ing", " the", "  ", " 12", "'s", "<|endoftext|>"]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randint(0, 12))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in table.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_keeps_its_table(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_ROWS", 40)
    tokenizer = Tokenizer.from_file(BYTES)
    dice = random.Random(4)
    for _ in range(4):  # files of one worker, with words that come again and a table that is emptied between
        texts = [" ".join(dice.choice(["sol", "luna.", "x\ny", "año"]) + str(dice.randint(0, 20)) for _ in range(30)) for _ in range(5)]
        table = token_files.kept_table("".join(list(tokenizer.to_str())), "H", False)
        assert table is token_files.kept_table(tokenizer.to_str(), "H", False)
        assert [np.frombuffer(x, "<u2").tolist() for x in table.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert table.after


def test_added_tokens_like_the_library(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    dice = random.Random(3)
    bits = [*"ab  \n.é", " the", "<|endoftext|>", " <|endoftext|> ", "<|endof", "text|>"]
    texts = ["a <|endoftext|> b", *("".join(dice.choice(bits) for _ in range(dice.randint(0, 12))) for _ in range(2000))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    table = token_files.PieceTable(tokenizer.to_str(), "H", literal=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in table.encode(texts)] == want
    spaced = Tokenizer.from_file(BYTES)
    spaced.add_tokens(["the a"])
    table = token_files.PieceTable(spaced.to_str(), "H", literal=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in table.encode(texts)] == [spaced.encode(t, add_special_tokens=False).ids for t in texts]
    files = token_files.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), BYTES, str(tmp_path / "t"))
    got = {r["id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_files(files, str(tmp_path / "t")).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want)}


def test_token_files(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 60_000)
    monkeypatch.setattr(token_files, "FRAME_BYTES", 5_000)
    tokenizer = Tokenizer.from_file(BYTES)
    files = token_files.write_files(odd_docs, BYTES, str(tmp_path / "t"))
    assert files.count() > 1
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(token_files.read_files(files, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in rows]
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert got[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in itertools.pairwise(got))
    key = lambda i, ids: (i is None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(key(*w) for w in want)
    some = token_files.read_files(files, str(tmp_path / "t"), [4, 9]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in got if r["id"] in (4, 9))
    assert token_files.write_files(no_docs, BYTES, str(tmp_path / "none")).count() == 0
    name = files.orderBy("tokens").collect()[-1]["name"]
    data = bytearray((tmp_path / "t" / name).read_bytes())
    data[20] ^= 1
    (tmp_path / "t" / name).write_bytes(data)
    store, path = token_files.opened(str(tmp_path / "t" / name))
    with pytest.raises(Exception), store.open_input_file(path) as source:  # noqa: B017, PT011
        list(token_files.Reader(source).documents())


# ---- decontamination

def plain_hits(docs, items):
    cut = lambda t: re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = cut(text)
        n = min(len(w), decontaminate.SPAN)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id is None, doc_id or 0, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out)


def test_hits_of_odd_rows(spark, odd_docs, no_docs):
    items = [("1", "Over THE lazy dog and runs home again today the quick brown"), ("2", "über die straße"), ("2", "x"), ("10", "b c"), ("3", ""), ("4", None), (None, "el perro corre")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_hits(odd_docs, bench).collect()
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in got)
    assert have == plain_hits([(r["doc_id"], r["text"]) for r in odd_docs.collect()], items)
    kept = decontaminate.without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r["n_hit"] for r in got)
    none = decontaminate.find_hits(odd_docs, bench.where("false")).collect()
    assert len(none) == len(got) and not any(r["n_hit"] for r in none)
    assert decontaminate.find_hits(no_docs, bench).count() == 0


# ---- shards

def test_shards(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.range(3000).selectExpr("id + 100 as doc_id", "repeat('ab ', cast(id % 50 as int)) as text", "null as lang", "0 as key", "0D as score", "'w' as words"))
    crowd = docs.unionByName(spark.range(400).selectExpr("7 as doc_id", "repeat('z', 100) as text", "null as lang", "0 as key", "0D as score", "'w' as words"))
    for frame in (docs, crowd):
        got = shards.assign(frame, 5000)
        rows = got.collect()
        assert len(rows) == frame.count()
        total = collections.Counter()
        for r in rows:
            total[r["shard"]] += len((r["text"] or "").encode())
        for r in rows:
            assert total[r["shard"]] == r["shard_bytes"] and len(r["shard"]) == r["depth"]
            assert total[r["shard"]] <= 5000 or r["shard_rows"] == 1
        names = sorted(total)
        assert not any(b.startswith(a) and a != b for a, b in itertools.pairwise(names))
        path = shards.write_shards(got)
        assert sorted(map(repr, shards.read_shards(got, path).select("doc_id", "shard").collect())) == sorted(map(repr, got.select("doc_id", "shard").collect()))
    assert shards.assign(no_docs, 10).count() == 0


# ---- near copies

def plain_groups(rows, length, least):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common_ = len(sets[a] & sets[b])
        if common_ and 100 * common_ >= least * (len(sets[a]) + len(sets[b]) - common_):
            up[root(b)] = root(a)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted((i is None, i or 0, len(s), low.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("length", "least"), [(3, 90), (5, 80), (2, 60)])
def test_groups_of_chains_and_copies(spark, length, least):
    dice = random.Random(length)
    rows = []
    for group in range(6):
        words = [f"w{group}x{dice.randint(0, 30)}" for _ in range(dice.choice([4, 9, 12, 40, 150]))]
        for _ in range(40):
            rows.append((len(rows), " ".join(words)))
            for _ in range(dice.randint(0, 2)):
                words[dice.randrange(len(words))] = f"e{dice.randint(0, 9)}"
    dice.shuffle(rows)
    got = near_copies.find_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), length=length, least=least).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, length, least)


@pytest.mark.parametrize("members", [2, 16, 1000])
def test_large_buckets_are_cut_into_blocks(spark, monkeypatch, members):
    """All pairs of different components, from tasks of about two blocks; none of a component with itself."""
    rows, labels = [], []
    for key, sizes in enumerate(([120, 1, 1], [30, 25, 1, 1, 2], [1] * 40, [50], [3, 2])):
        for at, size in enumerate(sizes):
            group = [key * 1000 + at * 150 + i for i in range(size)]
            rows += [(key, n) for n in group]
            labels += [(n, group[0]) for n in group if size > 1]
    label = {n: n for _, n in rows} | dict(labels)
    want = {(max(a, b), min(a, b)) for k, a in rows for j, b in rows if k == j and label[a] != label[b]}
    nodes = spark.createDataFrame([(n, 100, bytes(near_copies.SKETCH_BITS // 8)) for n in label], "node bigint, size bigint, sketch binary")
    most = []
    real = type(nodes.groupBy("node")).applyInArrow

    def counted(self, f, schema):
        most.append(max(r["count"] for r in self.count().collect()))
        return real(self, f, schema)

    monkeypatch.setattr(type(nodes.groupBy("node")), "applyInArrow", counted)
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    buckets, linked = spark.createDataFrame(rows, "key bigint, node bigint"), spark.createDataFrame(labels, "node bigint, label bigint")
    got = [(r["a"], r["b"]) for r in near_copies._across(buckets, linked, nodes, 80).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert most[0] <= max(30, 4 * members)


@pytest.mark.parametrize("members", [2, 5])
def test_groups_from_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    test_groups_of_chains_and_copies(spark, 3, 60)


@pytest.mark.parametrize("least", [60, 80, 90])
def test_linked_sets_share_a_key(least):
    """Every split of the work, with and without left-out shingles, keeps all links."""
    dice = np.random.default_rng(5)
    for texts in (1, 10**5, 10**9):
        bands = near_copies.Bands(least, dict.fromkeys(range(400), texts))
        for size in (1, 2, 7, 10, 19, 60, 300):
            for _ in range(20):
                a = dice.integers(0, 2**63, size).astype(np.uint64)
                keep = dice.integers(max(1, size * least // 100), size + 1)
                b = np.unique(np.concatenate([a[:keep], dice.integers(0, 2**63, dice.integers(0, size // 5 + 2)).astype(np.uint64)]))
                a = np.unique(a)
                if near_copies.linked(a, b, least):
                    keys = [bands.keys(x, near_copies.mix(x, 5)) for x in (a, b)]
                    assert len(np.intersect1d(*keys))


@pytest.mark.parametrize(("length", "least"), [(3, 90), (5, 80), (2, 60)])
def test_index_holds_texts_that_can_have_links(spark, monkeypatch, length, least):
    """Texts whose shingles are all but their own stay out of the index; no link is lost."""
    dice = random.Random(length)
    rows = [(i, " ".join(f"{dice.randint(0, 400)}" for _ in range(dice.choice([30, 100, 165, 400])))) for i in range(300)]
    line = " ".join(f"common{i}" for i in range(12))
    rows += [(300 + i, f"{line} {t} {line}") for i, (_, t) in enumerate(rows[:100])]
    for size in (30, 120, 140, 158, 162, 170, 200, 600):  # about the size from which a part of the universe is counted
        words = [f"near{size}x{i}" for i in range(size)]
        for cut in (0, 1, size * (100 - least) // 100, size * (100 - least) // 100 + 1):
            rows.append((len(rows), " ".join(words[cut:])))
    held, real = set(), near_copies._buckets

    def counted(found):
        for r in found.collect():
            held.update(near_copies.unpacked(bytes(r["entries"]))[:, 1].tolist())
        return real(found)

    monkeypatch.setattr(near_copies, "_buckets", counted)
    monkeypatch.setattr(near_copies, "RUN_BYTES", 20_000)
    got = near_copies.find_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), length=length, least=least).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, length, least)
    # Pairs of 400 words are shared by most texts, so there many stay.
    assert length == 2 or 50 < len(held) < len(rows) * 3 // 4


def test_groups_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = near_copies.find_groups(odd_docs, length=3, least=90).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, 3, 90)
    kept = near_copies.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert near_copies.find_groups(no_docs).count() == 0 and near_copies.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_equal_ids_at_other_texts_and_of_rows_without_id(spark, seed):
    """Links come from each row's own text, in any order of the rows."""
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join([*words[:39], "x"])  # 34 of 38 shingles in common
    c, d, e, f = ("".join(f"{k}{i} " for i in range(12)) for k in "cdef")
    rows = [(1, a), (1, c), (2, b), (None, d), (None, d), (5, d + " "), (None, e), (None, e), (7, c), (9, f), (9, f)]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((i is None, i or 0, t, {a: 1, b: 1, c: 1, d: 5, e: None, f: 9}[t.strip() if t.strip() in (a, b) else t.rstrip() + " "]) for i, t in rows)
    base = near_copies._groups(docs, "doc_id", "text", 5, 80)
    texts = {spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0]: t for _, t in rows}
    assert sorted((r["id"] is None, r["id"] or 0, texts[r["said"]], r["component_id"]) for r in base.collect()) == want
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in near_copies.one_of_each(docs).collect()))
    first = min((1, a), (1, c), key=lambda r: r[1])
    assert first[0] == 1 and kept == sorted([(False, 1, a), (False, 1, c), (False, 5, d + " "), (True, 0, e), (False, 9, f)])


def test_tables_are_bounded_by_bytes():
    """Texts without spaces are single words and chunks of some KB; they are not kept."""
    words = near_copies.Words()
    dice = random.Random(1)
    texts = ["".join(chr(dice.randint(0x4E00, 0x9FFF)) for _ in range(800)) for _ in range(200)]
    for t in texts:
        near_copies.shingles(t.encode(), words, 5)
    assert not words
    for i in range(400_000):
        words[b"%d" % i]
    assert words.held <= near_copies.TABLE_BYTES + 400 and len(words) * near_copies.ENTRY_BYTES <= near_copies.TABLE_BYTES + 400
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.ChunkTable(sp)
    assert [list(array.array("i", x)) for x in table.encode(texts)] == sp.encode(texts) and not table.ids
    assert [list(array.array("i", x)) for x in table.encode(["a b " + texts[0] + " b", ""])] == sp.encode(["a b " + texts[0] + " b", ""])
    assert table.held <= pieces.TABLE_BYTES and set(table.ids) == {"a", "b"}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in near_copies.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}


# ---- fingerprints

def test_fingerprints(odd_docs, no_docs):
    marked = merkle.with_fingerprint(odd_docs, "text", "f").collect()
    texts = collections.defaultdict(set)
    for r in marked:
        texts[r["text"] or ""].add(r["f"])
    assert all(len(v) == 1 for v in texts.values()) and len(set.union(*texts.values())) == len(texts)
    assert merkle.with_fingerprint(no_docs, "text", "f").count() == 0


def test_edits_are_located(spark):
    lines = [f"Line {i} says this. And that!" for i in range(30)]
    other = [*lines[:17], "Line x.", *lines[18:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    row = df.select(merkle.changed_branches(F.col("fa"), F.col("fb")).alias("c"), merkle.likeness(F.col("fa"), F.col("fb")).alias("n"), merkle.likeness(F.col("fa"), F.col("fa")).alias("s")).first()
    assert row["c"] == [17] and 0.9 < row["n"] < 1 and row["s"] == 1


def test_next_texts(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(merkle, "RUN_ROWS", 3)
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in odd_docs.collect()), key=lambda r: (-r[0], r[1]))
    want = sorted((k, t, rows[(i + 1) % len(rows)][1]) for i, (k, t) in enumerate(rows))
    got = merkle.with_next(odd_docs, "doc_id", "text", "following").collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"], r["following"]) for r in got) == want
    assert merkle.with_next(no_docs, "doc_id", "text", "following").count() == 0
    one = merkle.with_next(odd_docs.where("doc_id = 8"), "doc_id", "text", "following").first()
    assert one["following"] == one["text"]


def test_shared_tables_are_read_by_spark(spark, data):
    assert common.table(spark, data, "documents").count() == 200
    assert hashlib.md5(LINES[0].encode()).hexdigest()  # the hash of the fingerprints is the library's
