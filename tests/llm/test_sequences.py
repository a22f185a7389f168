"""Phrases, conversation tries and repeated byte strings against brute force, with every kind of odd row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import phrases, suffixes, trie

DOCS = "doc_id long, text string, lang string, k1 long, spans string, n long, core long, phrase string, _at long"


def docs(spark, texts, langs=None, ids=None):
    """Columns with the names of internal ones stand beside."""
    rows = [(i if ids is None else ids[i], t, langs[i % len(langs)] if langs else "en", 7, "s", 1, 2, "p", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- phrases

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def phrases_by_hand(texts, langs, least, most, top):
    f, n = Counter(), Counter()
    for i, text in enumerate(texts):
        lang = langs[i % len(langs)] or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for at in range(len(words) - k + 1):
                    f[lang, tuple(words[at : at + k])] += 1
    known = {x: a for x, a in f.items() if a >= least}
    inside = {(lang, p[i:j]) for (lang, p), a in known.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and known[lang, p[i:j]] <= a}
    out = defaultdict(list)
    for (lang, p), a in known.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def chatter(seed, n=150):
    rng = random.Random(seed)
    parts = ["the", "The", "of", "a", "naïve", "état", "x.y", "in the end", "by and by,", "out; of", "one two three four five six", "\t", "\x0b", "!", "\r\n", "zz zz zz"]
    return [" ".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "\n\n", "a" * 3000, "the of " * 400, "same old same old.", "same old same old."]


@pytest.mark.parametrize("cells", [16, 1 << 12])
@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_equal_brute_force(spark, cells, shards):
    """With 16 cells all phrases share cells and are counted early; counts stay exact."""
    texts, langs = chatter(1), ["en", "fr", None, "en", "en"]
    got = phrases.collocations(docs(spark, texts, langs), least=5, most=5, top=12, shards=shards, cells=cells)
    assert {tuple(r) for r in got.collect()} == phrases_by_hand(texts, langs, 5, 5, 12)


@pytest.mark.parametrize("cells", [64, 256])
def test_phrases_that_share_some_cells_equal_brute_force(spark, cells):
    """Cells that are all set by others before a phrase is counted do not start its longer phrases."""
    texts, langs = chatter(3), ["en", "fr", None, "en", "en"]
    got = phrases.collocations(docs(spark, texts, langs), least=5, most=5, top=10**6, shards=3, cells=cells)
    assert {tuple(r) for r in got.collect()} == phrases_by_hand(texts, langs, 5, 5, 10**6)


def test_rare_pairs_of_frequent_words_are_not_counted(spark, monkeypatch):
    rng, seen = random.Random(4), []
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=30)) + ", new york city" for _ in range(80)]
    real = phrases.staged
    monkeypatch.setattr(phrases, "staged", lambda df, tag: seen.append((tag, real(df, tag))) or seen[-1][1])
    got = phrases.collocations(docs(spark, texts), least=20, most=3, top=100, shards=1)
    assert {tuple(r) for r in got.collect()} == phrases_by_hand(texts, ["en"], 20, 3, 100)
    counted = {r["phrase"] for tag, df in seen if tag == "counts" for r in df.filter("k > 1").collect()}
    assert counted == {"new york", "york city", "new york city"}


def test_rare_words_are_not_counted_and_rounds_read_what_likely_pairs_leave(spark, monkeypatch):
    rng, seen, read = random.Random(6), [], []
    texts = [" ".join([*rng.choices([f"w{i}" for i in range(40)], k=30), f"rare{i}", "once", "New York"]) for i in range(80)] + ["of course"] * 9 + [""]
    staged, one_round = phrases.staged, phrases._round
    monkeypatch.setattr(phrases, "staged", lambda df, tag: seen.append((tag, staged(df, tag))) or seen[-1][1])
    monkeypatch.setattr(phrases, "_round", lambda shard, *rest: read.append(shard) or one_round(shard, *rest))
    langs = ["en", None]
    got = phrases.collocations(docs(spark, texts, langs), least=20, most=3, top=100, shards=2)
    assert {tuple(r) for r in got.collect()} == phrases_by_hand(texts, langs, 20, 3, 100)
    words = Counter((langs[i % 2] or "und", w) for i, t in enumerate(texts) for w in t.lower().split())
    counted = {(r["lang"], r["phrase"]) for tag, df in seen if tag == "counts" for r in df.filter("k = 1").collect()}
    assert counted == {w for w, n in words.items() if n >= 20}
    assert "text" not in read[0].columns
    # once new york: three places of each of the 80 texts
    assert sum(len(ids) for df in read[:2] for b in df.toArrow().to_batches() for *_, ids, _ in phrases._unpacked(b)) == 3 * 80


def test_phrases_without_frequent_ones(spark):
    assert phrases.collocations(docs(spark, ["a b", None, ""])).count() == 0
    assert phrases.collocations(docs(spark, ["a b"]).limit(0)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big, big * 9, big + 1, big + 3)], "a long, n long, l long, r long")
    assert row.select(phrases._score("a", "n", "l", "r")).first()[0] == 1000 * big * big * 9 // ((big + 1) * (big + 3))


# --- conversations


def trie_by_hand(conv, rebuilt):
    node, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            node[tuple(turns[:d])].append(c)
    for k in node:
        kids[k[:-1]] += bool(k)
    for k, members in node.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    out = set()
    for k, members in node.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(k))))
        out.add((min(members), len(k), min(node[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_trie_equals_brute_force(spark, block):
    rng = random.Random(5)
    conv, rows = {}, []
    for c in [*range(60), -3, 10**12, 10**12 + 1]:
        turns = [(rng.choice(["user", None, "bot"]), rng.choice(["hi", "hello", None, "é" * 40, ""])) for _ in range(rng.choice([1, 2, 5, 9, 12]))]
        if c % 4 == 0:
            turns = [("user", "same")] * 7
        conv[c] = [(a or "", b or "") for a, b in turns]
        rows += [(c, None if i == 0 else i, a, b, 1, "x") for i, (a, b) in enumerate(turns)]
    rows += [(None, 0, "user", "nobody's", 1, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, lo string").repartition(4)
    turns = trie.ordered_turns(df)
    sizes, rebuilt = trie.forked(turns, lambda c: F.pmod(c, F.lit(4)), lambda c: c - F.pmod(c, F.lit(5)), 3)
    want = {}
    for c in conv:
        h, base = c % 4, conv.get(c - c % 5, [])
        want[c] = base[:h] + conv[c][h:]
    got = trie.trie(rebuilt, sizes, block=block)
    assert {tuple(r) for r in got.collect()} == trie_by_hand(conv, want)


def test_turns_of_one_number_and_repeated_rows_are_ordered_by_content(spark):
    rows = [(1, 3, "b", "y"), (1, 3, "a", "z"), (1, 3, "a", "z"), (1, None, "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.ordered_turns(df).orderBy("_at").collect()
    assert [r["_at"] for r in got] == [0, 1, 2, 3] and [r["bytes"] for r in got] == [0, 1, 1, 1]
    assert got[1]["turn"] == got[2]["turn"] == hashlib.sha256(b"1:az").hexdigest() and got[3]["turn"] != got[2]["turn"]


def test_one_conversation_over_many_partitions(spark):
    """Places go on across the borders of ranges."""
    rows = [(1, i, "u", str(i)) for i in range(500)] + [(2, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = trie.ordered_turns(df).filter("conv_id = 1").select("_at", "turn").collect()
    assert {r["_at"]: r["turn"] for r in got} == {i: hashlib.sha256(f"1:u{i}".encode()).hexdigest() for i in range(500)}


def test_empty_trie(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    sizes, rows = trie.forked(trie.ordered_turns(df), lambda c: c, lambda c: c, 1)
    assert trie.trie(rows, sizes).count() == 0


def test_perfect_hash_tells_strangers():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, 5000), dtype=np.int64)
    table = trie.PerfectHash(keys[0], keys[1])
    assert sorted(table.slots(keys[0], keys[1])) == list(range(5000))
    assert (table.slots(keys[1], keys[0]) == -1).all()
    assert (trie.PerfectHash(keys[0][:0], keys[1][:0]).slots(keys[0], keys[1]) == -1).all()


# --- repeated strings


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = re.findall(rb"\x01+", bytes(gone))
        out.append((len(b), sum(map(len, runs)), len(runs), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def tangled(seed, length):
    rng = random.Random(seed)
    letters = "abcdefgh éß "
    line = lambda n: "".join(rng.choices(letters, k=n))
    passages = [line(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [line(rng.randint(0, length * 3)) + rng.choice(passages) + line(rng.randint(0, length)) + rng.choice(passages) for _ in range(25)]
    near = line(length * 6)
    for _ in range(12):
        at = rng.randrange(len(near))
        texts.append(near[:at] + rng.choice(letters) + near[at + 1 :])
        texts.append(near[rng.randrange(length) : rng.randrange(length, len(near))])
    texts += ["a" * n for n in (length - 1, length, length + 1, 3 * length)] + ["ab" * length, "ba" * length, "abc" * length * 2]
    return texts + [None, "", " ", "x", near, near, "short", "short", "é" * length, "one line\n" * length]


@pytest.mark.parametrize(("length", "bits"), [(400, 1 << 20), (400, 64), (900, 1 << 20)])
def test_repeats_equal_brute_force(spark, length, bits):
    """A table of 64 bits lets everything through: the result stays."""
    texts = tangled(length, length)
    ids = list(range(len(texts)))
    got = suffixes.without_repeats(docs(spark, texts, ids=ids), length, bits=bits).collect()
    want = repeats_by_hand(texts, length)
    assert len(got) == len(texts)
    for r in got:
        kept, spans = bytes(r["kept"]), r["spans"]
        assert (r["n_bytes"], r["n_bytes"] - len(kept), len(spans), kept) == want[r["doc_id"]], r["doc_id"]
        assert sum(s["hi"] - s["lo"] for s in spans) == r["n_bytes"] - len(kept)


def test_few_windows_are_compared_one_by_one(spark, monkeypatch):
    """Passages of 500 to 3,000 bytes between words of their own, whole and cut off: as by brute force, with less than a third of the windows at their edges as rows."""
    rng = random.Random(17)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [own(n) for n in (500, 700, 1500, 3000)]
    texts = [own(rng.randrange(300)) + p[rng.choice([0, 0, 37]) : rng.choice([None, None, -53])] + own(rng.randrange(300)) for p in passages for _ in range(12)]
    rows, write = {}, suffixes.staged

    def counted(df, tag):
        out = write(df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(suffixes, "staged", counted)
    got = suffixes.without_repeats(docs(spark, texts, ids=list(range(len(texts)))), 400).collect()
    want = repeats_by_hand(texts, 400)
    for r in got:
        kept = bytes(r["kept"])
        assert (r["n_bytes"], r["n_bytes"] - len(kept), len(r["spans"]), kept) == want[r["doc_id"]], r["doc_id"]
    assert len(got) == len(texts) and rows["windows"] < 1500


def test_rows_with_null_or_repeated_ids_are_texts_of_their_own(spark):
    rng = random.Random(9)
    one, two = ("".join(rng.choices("abcdef ", k=700)) for _ in range(2))
    got = suffixes.without_repeats(docs(spark, [one, one, two, two[:350]], ids=[None, 5, 5, None])).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in got) == [(0, 0), (0, 350), (5, 0), (5, 700)]
    assert suffixes.without_repeats(docs(spark, [one]).limit(0)).count() == 0


# --- without a library


def test_a_missing_library_leaves_the_panel(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    load = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name.split(".")[0] in ("ahocorasick", "xxhash"):
            raise ImportError(name)
        return load(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith(("barloom.llm", "corpus_pipeline")) or m in ("ahocorasick", "xxhash")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", blocked)
    with pytest.warns(UserWarning):
        names = entry.queries()
    assert "weighted_index" in names and not any(n.startswith("op") for n in names)
