"""Brute-force checks of conversation repair, SentencePiece and whitening."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\r\x0b\x0c"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest (cost, audit) and repaired rows by Dijkstra's search over (rows read, role initials so far as a state)."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        kept = text.strip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out), faults
        if (i, state) in done:
            continue
        done.add((i, state))
        arcs = [(5, "I", i, c, (name, "")) for c, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            arcs.append((2, "D", i + 1, None, None))
            if faults[i] in ("", "truncated"):
                more, (_, _, role, text) = 5 * (faults[i] == "truncated"), rows[i]
                arcs.append((more, "K", i + 1, role[:1], (role, text)))
                arcs += [(1 + more, "R", i + 1, c, (name, text)) for c, name in (("u", "user"), ("a", "assistant"))]
        for price, label, at, c, row in arcs:
            if c is None:
                heapq.heappush(heap, (cost + price, audit + label, at, state, out))
            elif c in nexts[state]:
                heapq.heappush(heap, (cost + price, audit + label, at, nexts[state][c], (*out, row)))


def plain_audit(rows):
    damaged, out = plain_damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, repaired, faults = plain_repair(mine)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def random_conversations(seed, convs, longest):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for k in range(pick.randint(1, longest)):
            turn = pick.choice([k, k, k, k + 3, None])
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "unknown", "tool", "", None])
            rows.append((conv, turn, role, pick.choice(["Hi.", "Yes!", "no end", "", " \n", None, f"word {pick.random()}?", f"ends. {pick.random()}"])))
    return rows


@pytest.mark.parametrize("bits", [1, 10])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    from tripforge.llm import conversations as C

    monkeypatch.setattr(C, "STRETCH_BITS", bits)
    rows = random_conversations(bits, 150, 14)
    got = C.audit_conversations(spark.createDataFrame(rows, CONVERSATIONS).withColumn("stretch", F.lit("clash")).withColumn("pos", F.lit("x")))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_audit(rows)


def test_repair_of_a_long_conversation_of_equal_and_unlike_rows(spark):
    from tripforge.llm import conversations as C

    pick = random.Random(3)
    rows = [(1, k, pick.choice(["user", "assistant"]), f"{k} is a number.") for k in range(3000)] + [(2, None, "user", "same.")] * 2500 + [(3, 0, "user", None), (4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "user", "b.")]
    got = {r[0]: tuple(r)[1:] for r in C.audit_conversations(spark.createDataFrame(rows, CONVERSATIONS).repartition(7)).collect()}
    want = plain_audit(rows)
    assert got[4][0] is None and got[4][1:] == want[4][1:]
    assert all(got[k] == want[k] for k in (1, 2, 3))


def test_weights_of_stretches_multiply_to_those_of_the_whole():
    from tripforge.llm import conversations as C

    pick = random.Random(5)
    for _ in range(300):
        rows = "".join(pick.choices(C.INITIALS + C.CUT + C.GONE, k=9))
        for start in range(4):
            best = {}
            for middle, (c1, l1) in C.shortest_paths(rows[:4], start).items():
                for end, (c2, l2) in C.shortest_paths(rows[4:], middle).items():
                    best[end] = min(best.get(end, (1 << 60, "")), (c1 + c2, l1 + l2))
            assert best == C.shortest_paths(rows, start)


# --- SentencePiece --------------------------------------------------------------------------------


def piece_library():
    import sentencepiece
    from tripforge.llm import pieces as P

    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


ODD_TEXT = "ab  ▁é\n\t0123456789.,你好😀́\x00�the in ﬁ　\xa0​\xad"


def test_pieces_spans_and_texts_equal_the_library(spark):
    from sentencepiece import sentencepiece_pb2

    from tripforge.llm import pieces as P

    library, pick = piece_library(), random.Random(1)
    texts = ["".join(pick.choices(ODD_TEXT, k=pick.randint(0, 40))) for _ in range(800)] + [None, "", " ", "x" * 3000 + " " * 500, "word " * 5000, "1234567890" * 300, "▁▁▁ ▁"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "a"), (5, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("spans", F.lit("clash"))
    coded = P.encode(rows, P.model_path(), spans="spans", end=True)
    back = {(r.doc_id, r.text): r.decoded for r in P.decode(coded, P.model_path()).collect()}
    for r in coded.collect():
        text = r.text or ""
        want = library.encode(text)
        assert r.ids == [*want, library.eos_id()]
        spans = [(p.begin, p.end) for p in sentencepiece_pb2.SentencePieceText.FromString(library.encode(text, out_type="serialized_proto")).pieces]
        assert [tuple(s) for s in r.spans] == [*spans, (len(text.encode()),) * 2]
        assert back[r.doc_id, r.text] == library.decode(r.ids)


def test_piece_decoder_takes_any_ids_in_any_portions():
    from tripforge.llm import pieces as P

    library, pick = piece_library(), random.Random(2)
    model = P.Model(open(P.model_path(), "rb").read())
    for _ in range(5000):
        ids = [pick.choice([pick.randrange(32000), pick.randrange(3, 259), pick.randrange(3), 259, 29871]) for _ in range(pick.randint(0, 14))]
        decoder, out, at = P.Decoder(model), "", 0
        while at < len(ids):
            step = pick.randint(1, 5)
            out += decoder.feed(ids[at : at + step])
            at += step
        assert out + decoder.feed([], True) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_maps_normalise_as_the_library_does(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from tripforge.llm import pieces as P

    library, pick = sentencepiece.SentencePieceNormalizer(rule_name=rule), random.Random(3)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    encoder = P.Encoder.__new__(P.Encoder)
    encoder.m = P.Model.__new__(P.Model)
    encoder.m.map = P.CharacterMap(spec.precompiled_charsmap)
    encoder.m.prefix, encoder.m.squeeze, encoder.m.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    for _ in range(3000):
        text = "".join(pick.choices(ODD_TEXT + "AÀÉﬀ㍿ｱﾞÅ①²", k=pick.randint(0, 20)))
        normal, begins = encoder.normalise(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal == want and begins.tolist() == [len(text[:o].encode()) for o in offsets]


# --- whitening ------------------------------------------------------------------------------------


def plain_whitening(vectors):
    """Rows (vec_id, component) -> (n, deviation, |whitened|, explained) with exact integers and one float eigh."""
    from fractions import Fraction

    whole = [(k, tuple(int(np.floor(256.0 * float(c))) for c in v)) for k, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({x for _, x in whole})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    out = {}
    for k, x in whole:
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(min(4, d)):
            value = abs(float(np.dot(np.array([float(Fraction(a, n)) for a in y]), u[:, -1 - c])) / np.sqrt(e[-1 - c]))
            out.setdefault((k, c + 1), []).append((n, sum(a * a for a in y), value, e[-1 - c] / float(sum(cov[i][i] for i in range(d)))))
    return out


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_whitening_equals_exact_arithmetic(spark, far):
    from tripforge.llm import whitening as W

    g = np.random.default_rng(4)
    mix = np.diag([3.0, 2.0, 1.5, 1.0, 0.5, 0.3])
    vectors = [(k, [float(c) for c in row]) for k, row in enumerate(np.float32(g.normal(size=(400, 6)) @ mix + far))]
    vectors += [(7, vectors[7][1]), (None, vectors[8][1]), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = W.whitened_components(rows.repartition(3)).collect()
    want = plain_whitening(vectors)
    assert len(got) == sum(map(len, want.values())) == 4 * 402
    for r in got:
        n, deviation, value, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - value) < 1e-6 and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-6


def test_residue_products_are_exact_beyond_doubles():
    from tripforge.llm import whitening as W

    g = np.random.default_rng(5)
    y = g.integers(-(1 << 40), 1 << 40, (40000, 3))
    primes = W.primes_for(40000 << 80)
    got = W.remainder_to_number([W.residue_products(y, p) for p in primes], primes)
    big = y.astype(object)
    assert (got == big.T @ big).all()


def test_whitening_of_lengths_constants_and_nothing(spark):
    from tripforge.llm import whitening as W

    schema = "vec_id long, embedding array<double>"
    assert W.whitened_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [5.0]), (4, []), (5, [1e300, 1.0, 0.0]), (6, [-1e300, 2.0, 1.0])]
    got = {(r.vec_id, r.component): r for r in W.whitened_components(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), *((k, c) for k in (5, 6) for c in (1, 2, 3))}
    assert abs(abs(got[1, 1].whitened) - 1) < 1e-9 and got[1, 2].whitened == 0 and got[3, 1].whitened == 0
    assert got[5, 1].deviation is None and abs(got[1, 1].identity_error) < 1e-9
