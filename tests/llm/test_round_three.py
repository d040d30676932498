"""Hard negatives, the prefix trie and SentencePiece pieces against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import pieces, prefix_trie, queries, radix

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts(library, n=300):
    rng = random.Random(5)
    some = [library.id_to_piece(i) for i in range(3, 32000)]
    out = [None, "", " ", "  a", "a  ", "\t\n a", "▁x", "\0a", "<s>", "</s> <0x0A>", "😀😀", "﷽", "a" * 300, " " * 99, " \n\n  \n", "ab" * 5000, "日本語のテキスト", "the  the   the"]
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            out.append("".join(rng.choice(some) for _ in range(rng.randint(1, 14))))
        elif kind == 1:
            out.append("".join(rng.choice("ab ▁the\n") for _ in range(rng.randint(1, 60))))
        elif kind == 2:
            out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x3000), rng.randint(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 30))))
        else:
            out.append(" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(20)))
    return out


def test_pieces_are_those_of_the_library(spark, library):
    each = texts(library)
    df = spark.createDataFrame([(i % 7 or None, t, "x", [i]) for i, t in enumerate(each)], "doc_id long, text string, decoded string, ids array<int>")
    got = pieces.encode_pieces(df, decoded=True).collect()
    want = [library.encode(t or "", add_eos=True) for t in each]
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=i % 7 or None, ids=w, decoded=library.decode(w))) for i, w in enumerate(want))
    bare = pieces.encode_pieces(df, with_end=False).where("doc_id = 3").collect()
    assert sorted(r["ids"] for r in bare) == sorted(library.encode(t or "") for i, t in enumerate(each) if i % 7 == 3)


def test_any_ids_decode_as_in_the_library(spark, library):
    rng = random.Random(6)
    rows = [[rng.choice([rng.randint(0, 31999), rng.randint(0, 300), 0, 1, 2, 259, 28705]) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    got = pieces.decode_pieces(spark.createDataFrame(list(enumerate(rows)), "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == {i: library.decode(x) for i, x in enumerate(rows)}
    odd = spark.createDataFrame([(None, None), (1, []), (1, [None])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in pieces.decode_pieces(odd).collect()] == ["", "", library.decode([0])]


def test_pieces_of_the_given_table(spark, library):
    got = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_pieces(none, decoded=True).collect() == []


# ---- The trie


def plain_trie(rows, every=5, most=8):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (c % every if c >= 0 else -(-c % every))
        full[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = sum(saved[q] for q in below[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))))
        for p, m in members.items()
    )


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2, True) for r in rows], "conv_id long, turn long, role string, text string, key string, n long, node long, last boolean").repartition(5)
    turns, lengths, scratch = prefix_trie.rebuilt_conversations(df)
    return prefix_trie.prefix_trie(turns, lengths, scratch)


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def flat(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def conversations(seed, convs, vocab):
    rng, out = random.Random(seed), []
    for c in convs:
        for t in range(rng.randint(1, 12)):
            out.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(vocab)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_plain_version(spark, seed):
    rows = conversations(seed, [*range(-12, 45), 10**9, 10**9 + 1], ["", None, "é", "yes", "no"])
    rows += rows[:9] + [(None, 1, "user", "nobody")]
    rows += [(c, t, "user", "copy") for c in range(100, 130) for t in range(9)]  # copies that end in one node
    rows += [(200, t, "user", "long") for t in range(40)] + [(201, t, "user", "long") for t in range(30)]
    assert flat(trie(spark, rows)) == sorted(plain_trie(rows), key=repr)


def test_trie_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PARTS", 2)
    rows = conversations(3, range(25), ["a", "b"]) + [(300, t, "user", f"{t}") for t in range(50)]
    assert flat(trie(spark, rows)) == sorted(plain_trie(rows), key=repr)


def test_trie_of_one_conversation_of_turnless_ones_and_of_none(spark):
    one = [(7, 0, "user", "x"), (7, 1, "user", "y")]
    assert flat(trie(spark, one)) == sorted(plain_trie(one), key=repr)
    # crc32("1") % 9 is 2: with one turn and no conversation 0, conversation 1 keeps none.
    less = [(c, 0, "user", "x") for c in (1, 2, 3, 4)]
    assert flat(trie(spark, less)) == sorted(plain_trie(less), key=repr)
    assert flat(trie(spark, [(None, 0, "user", "x")])) == []


# ---- Hard negatives


def plain_negatives(rows, every=100, positives=5, k=10, scale=256):
    import math

    own = []
    for at, (i, v, lab) in enumerate(rows):
        if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((at, i, [math.floor(scale * x) for x in v], lab))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in own:
        if a[1] % every:
            continue
        good = sorted((-score(a, b), b[1]) for b in own if b[3] == a[3] and b[0] != a[0])[:positives]
        bad = sorted((-score(a, b), b[1]) for b in own if b[3] != a[3])
        for s, p in good:
            for rank, (t, n) in enumerate([x for x in bad if 30 * -s <= 100 * -x[0] <= 90 * -s][:k], 1):
                out.append((a[1], p, rank, n, -s, -t))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "vec_id long, embedding array<float>, label int, anchor string, `row` long, id long").repartition(4)
    got = radix.mine_hard_negatives(df, **how).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def vectors(seed, n, values, dim=4):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i * 10**6]), [float(rng.choice(values)) for _ in range(dim)], rng.choice([0, 1, 2])) for i in range(n)]
    return rows + [(None, [1.0] * dim, 1), (900, None, 1), (901, [1.0] * dim, None), (902, [1.0, None, 1.0, 1.0], 1), (903, [1.0, float("nan"), 1.0, 1.0], 1), (904, [1.0, float("inf"), 1.0, 1.0], 0), (100, [0.5, 0.25], 1), (905, [], 2)]


@pytest.mark.parametrize("how", [{}, {"base": 64, "spare": 0}, {"spare": 1, "block_bytes": 30000}])
def test_negatives_equal_the_plain_version(spark, how):
    rows = vectors(1, 500, [-1, -0.25, 0, 0.5, 1])
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(1000, 1400)]  # one score, many ids
    rows += [(1200, [0.5, 0.5, 0.5, 0.5], 1)] * 70  # one score and one id
    assert mined(spark, rows, **how) == plain_negatives(rows)


def test_negatives_of_large_numbers(spark):
    rng = random.Random(4)
    for size in (10.0**4, 10.0**6, 10.0**15):
        rows = [(i, [rng.uniform(0, size) for _ in range(3)], i % 2) for i in range(0, 2000, 20)]
        rows = [(i, [float(F_) for F_ in map(_single, v)], lab) for i, v, lab in rows]
        want = plain_negatives(rows)
        if size < 10.0**15:
            assert mined(spark, rows, base=16, spare=2) == want
        else:  # scores are beyond a long: a defined result, no crash
            assert mined(spark, rows) is not None


def _single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_negatives_of_little(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [(1, [1.0], 1), (2, [0.5], 2)]) == []
