"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textlattice.llm import decontamination, fmindex, language, minhash, packing, pii, quality, repeats, sharding, suffixes, toxicity
from textlattice.llm.common import blocks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, bands string, chunk string, rep string"


def make(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(50, 90))) for _ in range(4)]
    out = []
    for k in range(n):
        if k % 7 == 3 and out:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
            continue
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, 1), rng.choice(passages))
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return [*out, None, "", " \n ", out[0], "x" * 60, "x" * 49, "a b", "a b"]


def removed(docs, n=50):
    least = {}
    for i, u in docs:
        for s in range(len(u) - n + 1):
            key = tuple(u[s : s + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, u in docs:
        gone = [False] * len(u)
        for s in range(len(u) - n + 1):
            if least[tuple(u[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        out.append(gone)
    return out


def test_repeated_bytes(spark):
    texts = corpus()
    ids = [*range(len(texts) - 1), 3]
    got = sorted(tuple(r) for r in suffixes.remove_repeated_bytes(make(spark, texts, ids)).collect())
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, u, gone in zip(ids, raw, removed(list(zip(ids, raw, strict=True))), strict=True):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(u), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 0


def test_repeated_words(spark):
    texts = corpus(2)
    got = sorted(tuple(r) for r in fmindex.remove_repeated_words(make(spark, texts)).collect())
    raw = [(t or "").encode().split() for t in texts]
    want = []
    for i, (u, gone) in enumerate(zip(raw, removed(list(enumerate(raw))), strict=True)):
        want.append((i, len(u), sum(gone), hashlib.sha256(b" ".join(b for b, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    assert got == want
    assert sum(w[2] for w in want) > 0


def test_repeats_null_ids_and_empty(spark):
    t = "word " * 60
    got = {r["doc_id"]: r["n_removed"] for r in fmindex.remove_repeated_words(make(spark, [t, t], [None, 5])).collect()}
    assert got == {None: 60, 5: 0}
    for f in (fmindex.remove_repeated_words, suffixes.remove_repeated_bytes):
        assert f(make(spark, [])).count() == 0


def test_loser_tree_and_front_coding():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    out, before = [], b""
    made = [suffixes.Run(*suffixes.front_code(r)) for r in runs]
    for run, at, known in suffixes.merge(made):
        s = runs[run][at]
        assert known == suffixes.common(before, s, 0)
        out.append(s)
        before = s
    assert out == sorted(itertools.chain(*runs))


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(3)
    text = np.append(np.repeat(rng.integers(1, 4, 150), rng.integers(1, 4, 150)), 0).astype(np.uint64)
    index = fmindex.FMIndex(text, np.zeros(len(text), np.int64), 8)
    ends = np.arange(5, len(text) - 1)
    matched, low, high = index.statistics(index.codes(text), ends, 5)

    def count(e, n):
        return sum((text[k : k + n] == text[e - n : e]).all() for k in range(len(text) - n + 1))

    for e, m, a, b in zip(ends, matched, low, high, strict=True):
        want = max((n for n in range(1, 6) if count(e, n) > 1), default=0)
        assert m == want and b - a == (count(e, 5) if want == 5 else 0)
    assert 0 < (matched == 5).sum() < len(ends) and index.heads.size < len(text)


def test_rank_over_runs():
    rng = np.random.default_rng(4)
    values = np.repeat(rng.integers(0, 6, 80), rng.integers(1, 5, 80))
    runs = fmindex.RunLengths(values, 6)
    for c in range(6):
        at = np.arange(len(values) + 1)
        assert (runs.rank(np.full(len(at), c), at) == np.concatenate([[0], np.cumsum(values == c)])).all()


@pytest.mark.parametrize("heavy", [2, 32])
def test_one_phrase_in_all_documents(spark, monkeypatch, heavy):
    """A phrase shorter than a passage, in other surroundings everywhere: its anchors must not bring all documents to one bucket."""
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rng = random.Random(7)
    phrase = " ".join(f"phrase{k}" for k in range(44))
    texts = [" ".join(f"x{rng.random()}" for _ in range(30)) + " " + phrase + " " + " ".join(f"y{rng.random()}" for _ in range(30)) for _ in range(240)]
    texts += [texts[3], texts[7] + " end", "start " + texts[9]]
    method = repeats.Method(repeats.word_units, fmindex.GRAM, fmindex.encode, fmindex.resolver(50))
    asked = repeats.remove_repeats(make(spark, texts), method, "doc_id", "text", asked_only=True)
    per_part = Counter()
    for r in asked.where("blob is not null").collect():
        per_part[r["part"]] += len(repeats.unpack(r["blob"])[0])
    raw = [(t or "").encode().split() for t in texts]
    want = [(i, len(u), sum(gone)) for i, (u, gone) in enumerate(zip(raw, removed(list(enumerate(raw))), strict=True))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in fmindex.remove_repeated_words(make(spark, texts)).collect())
    assert got == want
    if heavy == 2:
        assert max(per_part.values()) < 2 * sum(per_part.values()) / len(per_part)
    raw = [t.encode() for t in texts]
    want = [(i, len(u), sum(gone)) for i, (u, gone) in enumerate(zip(raw, removed(list(enumerate(raw))), strict=True))]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeated_bytes(make(spark, texts)).collect())
    assert got == want


def test_labels_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    labels = repeats.even_labels(7, 30)
    parts = [r["p"] for r in spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash("x"), F.lit(7)).alias("p")).collect()]
    assert parts == [k % 7 for k in range(30)] and len(set(labels)) == 30


def test_chunks_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    texts = corpus(12)
    raw = [(t or "").encode().split() for t in texts]
    want = [(i, len(u), sum(gone)) for i, (u, gone) in enumerate(zip(raw, removed(list(enumerate(raw))), strict=True))]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in fmindex.remove_repeated_words(make(spark, texts)).collect()) == want


def near_brute(texts, ids, size, percent):
    sets = defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in w]
        sets[i] |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [*corpus(4), *(" ".join(f"w{k}" if k != j else "new" for k in range(90)) for j in range(12)), "One TWO", "one two"]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(spark, texts), size=4).collect()}
    assert got == near_brute(texts, ids, 4, 80)
    kept = {r["doc_id"] for r in minhash.without_copies(make(spark, texts), size=4).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_blocks_of_one_family_are_not_all_paired(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    seen = []
    across = minhash.across

    def counted(*args):
        out = across(*args)
        seen.append((out.count(), out.select("family", "i", "j").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "across", counted)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:j % 190] + [f"n{j}"] + base[j % 190 + 1 :]) for j in range(400)]
    # members of the family that are alike in 0.6 or so of their shingles only
    texts += [" ".join(base[:150] + [f"s{j}x{k}" for k in range(50)]) for j in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, texts), size=4).collect()}
    assert got == {i: c for i, (_, c) in near_brute(texts, range(len(texts)), 4, 80).items()}
    assert set(got.values()) == {0, 400, 401, 402}
    # 26 blocks are 325 pairs of blocks and 10,000 rows; the three strays meet the members of their buckets only
    assert seen and all(rows < 2500 for rows, _ in seen)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(make(spark, [])).count() == 0
    rows = minhash.near_duplicates(make(spark, ["a b c d e f", None, "", "a b c d e f"], [None, 1, 2, 3])).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows} == {None: (None, True), 1: (1, True), 2: (2, True), 3: (3, True)}


def test_base_spans():
    text = "mail a.b@c.example.com. ip 10.0.0.300 1.2.3.4 card 4539 1488 0343 6467 call +1 (212) 555-0199 @ x@y"
    got = [(pii.KINDS[k], text[a:b]) for a, b, k in pii.base_spans(text)]
    assert got == [("email", "a.b@c.example.com"), ("ip", "1.2.3.4"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (212) 555-0199")]


def brute_spans(text):
    out = []
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(pats):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_plain_patterns():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("a.@-+ 0123456789()%\né") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_personal_data(spark):
    texts = ["write to bob.1@mail.example.com now", None, "", "nothing here", "call 212-555-0199 or (212) 555-0199 soon", "7" * 3000, "a@" * 2000]
    rows = {r["doc_id"]: r for r in pii.find_personal(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert all(f"{pii.KINDS[k]}:{a}:{b}" in rows[i]["spans"].split(",") for a, b, k in base)
    assert rows[3]["spans"] == ""
    red = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(make(spark, texts)).collect()}
    assert red[0] == ("write to <email> now", 20) and red[1] == (None, None)
    assert pii.find_personal(make(spark, [])).count() == 0


def test_tagger_on_held_out_sentences():
    net, rng = pii.train(), random.Random(12345)
    made = [pii._example(rng) for _ in range(150)]
    found = pii.model_spans([t for t, _ in made], net)
    hit = sum(len(set(g) & set(f)) for (_, g), f in zip(made, found, strict=True))
    assert hit >= 0.9 * sum(len(g) for _, g in made) and hit >= 0.9 * sum(map(len, found))


#: Labelled by hand; spans between braces, the kind's number after the first.
BY_HAND = [
    "Please write to {0jane.doe at example dot org} before Monday.",
    "Her address is {0jane (at) example.org} and his is {0max[at]web[dot]de}.",
    "Contact {0support @ shop.com} for refunds.",
    "The server {110[.]0[.]0[.]12} went down at noon.",
    "Ping {1192 . 168 . 1 . 20} and then restart.",
    "Card {24111.1111.1111.1111} was charged.",
    "Card {24111/1111/1111/1111} was declined, she said.",
    "Call {3(212) 555-0199} or {3212-555-0188} after six.",
    "Office: {3212.555.0147}, ask for Ann.",
    "Ring {30049 30 1234567} from abroad.",
    "Both cards, {24111111111111111} {25500000000000004} are his.",
    "She looked at the house. The dot on the map was red.",
    "Version 3.2.14 came out on 2021-04-05 at 10:30.",
    "We met at noon. Ann paid 1,250 euros for 12 chairs.",
]


def by_hand(marked):
    text, spans = "", []
    for part in re.split(r"(\{[^}]*\})", marked):
        if part.startswith("{"):
            spans.append((len(text), len(text) + len(part) - 3, int(part[1])))
            part = part[2:-1]
        text += part
    return text, spans


def test_added_spans_on_sentences_labelled_by_hand():
    texts = [by_hand(m) for m in BY_HAND]
    found = pii.find_all([t for t, _ in texts], pii.train())
    want = {(i, s) for i, (_, spans) in enumerate(texts) for s in spans}
    got = {(i, s) for i, (base, added) in enumerate(found) for s in added}
    assert not any(base for base, _ in found)
    assert len(got & want) >= 0.7 * len(want) and len(got & want) >= 0.9 * len(got)


def small_tagger(seed):
    """Random scores that reach far beyond 0, so that paths hold all labels."""
    net = pii.Tagger(np.random.default_rng(seed))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["t"] = np.where(pii._ALLOWED, np.random.default_rng(seed + 1).normal(size=net.p["t"].shape), -1e4)
    return net


def test_gradients_against_differences():
    net, rng = small_tagger(3), np.random.default_rng(4)
    x, y = rng.integers(0, 128, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [5, 6, 6, 0, 0, 7, 7]])
    _, g = net.step(x, y)
    for name, value in net.p.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            if name == "t" and not pii._ALLOWED[at]:
                continue
            keep, sides = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = keep + step
                sides.append(net.step(x, y)[0])
            value[at] = keep
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-5), (name, at)


def test_inference_gives_the_scores_of_training():
    net, x = pii.Tagger(np.random.default_rng(1)), np.random.default_rng(2).integers(0, 128, (5, 40))
    lengths = np.array([40, 40, 33, 2, 1])
    there, back = net.label_scores(x, lengths)
    for i, n in enumerate(lengths):
        assert np.allclose(there[:n, i] + back[:n, i][::-1], net.scores(x[i : i + 1, :n])[0][0], atol=1e-5)


def test_best_path_against_all_labellings():
    rng = np.random.default_rng(5)
    t = small_tagger(6).p["t"]
    offsets = np.array([0, 4, 4, 5, 9])
    u = rng.normal(0, 2, (9, pii.LABELS))
    got = pii.best_path(u, offsets, t)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        paths = itertools.product(range(pii.LABELS), repeat=int(b - a))
        best = max(paths, key=lambda y: sum(u[a + i, k] for i, k in enumerate(y)) + sum(t[p, q] for p, q in itertools.pairwise((0, *y, 0))))
        assert tuple(got[a:b]) == best


def test_skipping_certain_characters_changes_no_path():
    rng, net = random.Random(8), pii.train()
    texts = ["".join(pii._example(rng)[0] for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", "4" * 700, "a" * 900]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    u = pii.window_scores(net, pii.codes("".join(texts)), offsets[:-1], offsets[1:])
    for scores in (u, np.random.default_rng(1).normal(0, 3, u.shape).astype(np.float32)):
        assert (pii.best_path(scores, offsets, net.p["t"]) == pii.best_path(scores, offsets, net.p["t"], skip=False)).all()
    assert pii.certain(u, offsets, net.p["t"]).mean() > 0.1


def test_windows_cover_every_character_once(monkeypatch):
    class Echo:
        def label_scores(self, x, length):
            steps = np.repeat(x.T[:, :, None], pii.LABELS, 2).astype(np.float32)
            return steps, np.zeros_like(steps)

    sizes = [0, 1, pii.WINDOW, pii.WINDOW + 1, 5 * pii.STRIDE + 3, 0]
    offsets, values = np.concatenate([[0], np.cumsum(sizes)]), np.arange(sum(sizes))
    assert (pii.window_scores(Echo(), values, offsets[:-1], offsets[1:])[:, 0] == values).all()


def test_every_character_is_labelled_by_one_path_over_each_text():
    net, rng = pii.train(), random.Random(3)
    filler = " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(300))
    long = "jane" + ".doe" * 30
    texts = [filler, "x" * 500 + " jane (at) example.org " + filler, "", f"write to {long} (at) {'web-' * 20}shop.org today", filler + "7"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    scores = pii.window_scores(net, pii.codes("".join(texts)), offsets[:-1], offsets[1:])
    whole = pii.best_path(scores, offsets, net.p["t"], skip=False)
    assert (pii.text_labels(net, texts, offsets) == whole).all() and whole.any()
    # a span may be of any length
    assert pii.plausible(f"{long} (at) {'web-' * 20}shop.org", 0) and pii.plausible("jane at example dot org", 0) and not pii.plausible("jane dot example", 0)


def test_prose_is_outside():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 10))) for _ in range(200)) + "." for _ in range(20)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert (pii.text_labels(pii.train(), texts, offsets) > 0).mean() < 0.02


def test_personal_data_repeats_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.example.org", "x", 7), (1, "a@b.example.org", "x", 7), (None, "1.2.3.4", "x", 7)], "doc_id bigint, text string, spans string, n_email int")
    rows = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_personal(docs).collect())
    assert rows == [(0, 0, 1, "ip:0:7"), (1, 1, 0, "email:0:15"), (1, 1, 0, "email:0:15")]
    assert sorted(r["text"] for r in pii.redact(docs).collect()) == ["<email>", "<email>", "<ip>"]


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(3)
    texts = [*corpus(6), "tail space ", "two  spaces", "line\n\nbreaks \t x", "it's <|endoftext|> here", "émigré’s 123 çé", "y" * 5000, " lead", " ".join(rng.choice(["alpha", "be", "12"]) for _ in range(9000))]
    rows = packing.pack_sequences(make(spark, texts)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in ids.items():
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(whole) and crc == zlib.crc32(np.array(whole[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(whole)
    pad = 0
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad == 0
    assert packing.pack_sequences(make(spark, [])).count() == 0


def test_packing_places_pieces_anew_by_the_same_rule():
    rng = random.Random(6)
    for most in (4096, 5):
        packer, sizes, anew, tokens = packing.Packer(0, 64, most), [], 0, 0
        give_up = packer.give_up

        def watched(packer=packer, give_up=give_up):
            nonlocal anew
            emptiest = int(np.flatnonzero(packer.levels)[0])
            before = packer.n_open, int((packer.levels * np.arange(65)).sum())
            give_up()
            anew += emptiest
            assert packer.n_open < before[0] and int((packer.levels * np.arange(65)).sum()) <= before[1]

        packer.give_up = watched
        for k in range(400):
            size = min(500, int(rng.paretovariate(0.8) * 6))
            packer.add(k, np.arange(size, dtype="<u4").tobytes())
            tokens += size
            assert packer.n_open <= most
        packer.finish()
        for r in packer.rows:
            sizes.append(r[2])
        filled = defaultdict(int)
        for r in packer.rows:
            filled[r[5]] += r[2]
        last = [n for n in filled.values() if n != 64]
        assert sum(sizes) == tokens and packer.n_open == 0 and sorted(last) == [1 << b for b in range(6) if tokens % 64 >> b & 1]
        assert most == 5 or anew < tokens / 2


def test_packing_null_ids_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 5, "x")], "doc_id bigint, text string, sequence_id int, length string").coalesce(1)
    rows = packing.pack_sequences(docs).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == {1: 6, None: 1} and {r["doc_tokens"] for r in rows if r["doc_id"] is None} == {1}


def test_packing_minimises_sum_of_squares():
    packer = packing.Packer(0, 16)
    rng = random.Random(1)
    for k in range(300):
        levels = packer.levels.copy()
        rest = rng.randint(1, 15)

        def cost(h, levels=levels, rest=rest):
            after = levels.copy()
            after[h] -= h > 0
            after[h + rest] += 1
            return int((after[1:16] ** 2).sum())

        options = [h for h in range(16 - rest + 1) if h == 0 or levels[h]]
        best = min(cost(h) for h in options)
        packer.place((k, 0, bytes(4 * rest), rest), rest)
        assert int((packer.levels[1:16] ** 2).sum()) == best


def test_sharding(spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 251)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 251)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 60
    rows = sharding.place_documents(make(spark, ["a", None, "c"], [1, None, 1]), names, slots=251).collect()
    for r in rows:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) % 251
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        sharding.fill_table(names, 250)


def best_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(12)) for _ in range(8)]
    texts = []
    for k in range(40):
        noise = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(20))
        if k % 2:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 9)):
                item[rng.randrange(len(item))] = rng.choice(["", "zz", "q"])
            noise += " " + "".join(item) + "  " + noise
        texts.append(noise)
    texts += [None, "", items[0].upper().replace(" ", "\n")]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, " "), (100, items[0])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(make(spark, texts), bench, block_chars=200).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in [*enumerate(items), (100, items[0])]:
            d = best_substring(decontamination.normal(item), decontamination.normal(t or ""))
            if d <= int(len(decontamination.normal(item)) * decontamination.RATE):
                want[i, j] = d
    assert got == want and want
    assert {r["doc_id"] for r in decontamination.without_leaks(make(spark, texts), bench).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontamination.find_leaks(make(spark, texts), bench.limit(0)).count() == 0


def quality_brute(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality(spark):
    texts = [*corpus(8), "é ü\né ü\n\n \né ü", "a b c a b c x a b c", "#*$%&|<>"]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], quality_brute(t)
        assert tuple(r[c] for c in quality.BASE) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    empty = quality.judge(docs, quality.fit(docs, labels.limit(0)))
    assert all(r["kept"] != r["base_failed"] for r in empty.collect())


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    w, t = rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2))
    sizes = [0, 1, 3, 6, 2]
    x, bounds = rng.normal(size=(sum(sizes), quality.N_FEATURES)), np.concatenate([[0], np.cumsum(sizes)])
    got = quality.viterbi(x, bounds, w, t)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        u = x[a:b] @ w
        score = {y: sum(u[k] * y[k] for k in range(b - a)) + sum(t[p, q] for p, q in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=b - a)}
        best = max(score, key=score.get)
        assert tuple(got[a:b]) == tuple(y == 0 for y in best)


def test_quality_is_fitted_on_long_documents_too(spark, monkeypatch):
    long = "\n".join(f"Line {i} of words." for i in range(1001))
    docs = spark.createDataFrame([(0, long), (1, "One line.\nAnother line.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_crf", lambda sequences: seen.extend(sequences) or (None, None))
    quality.fit(docs, labels)
    assert [(len(x), q, n) for x, q, n in seen] == [(400, 0, 1001), (400, 0, 1001), (201, 0, 1001), (2, 1, 2)]


def test_pieces_of_a_document_share_its_weight():
    # without transitions to learn from, lines of one kind give the same weights whole or in pieces
    rng = np.random.default_rng(3)
    x, y = rng.random((1, quality.N_FEATURES)), rng.random((1, quality.N_FEATURES))
    once, twice = quality.fit_crf([(x, 0, 1), (y, 1, 1)]), quality.fit_crf([(x, 0, 2), (x, 0, 2), (y, 1, 1)])
    assert np.allclose(once[0], twice[0]) and np.allclose(once[1], twice[1])


def test_language(spark):
    rng = random.Random(4)
    sounds = {"aa": "atoke", "bb": "ñuxizq"}
    rows = []
    for i in range(80):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(5)) for _ in range(30)), lang))
    rows += [(80, None, "aa"), (81, "123 !", "bb"), (82, rows[0][1] + " " + rows[1][1], None), (83, "ñ", None), (84, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs.where("doc_id < 40"), "lang", "doc_id", "text")).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(80))
    assert [got[i]["lang_pred"] for i in (80, 81, 84)] == ["und"] * 3
    assert sorted(got[82]["languages"]) == ["aa", "bb"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    none = language.identify(docs, language.fit(docs.limit(0), "lang", "doc_id", "text"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert {r["doc_id"] for r in language.accepted(docs, language.fit(docs, "lang", "doc_id", "text")).collect()} == set(range(84)) - {80, 81}


def test_every_language_is_learned_and_mixtures_have_no_limit(spark):
    rng = random.Random(5)
    names = [f"l{k:02}" for k in range(70)]
    words = {x: ["".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(4)) for _ in range(20)] for k, x in enumerate(names)}
    # the last ones by count come last by name too
    rows = [(i, " ".join(words[x]), x) for i, x in enumerate([*names, *names[:64]])]
    mixed = " ".join(w for x in names[-5:] for w in words[x])
    docs = spark.createDataFrame([*rows, (200, mixed, None)], "doc_id bigint, text string, lang string")
    model = language.fit(docs, "lang", "doc_id", "text")
    assert model[0] == names
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows)
    assert sorted(got[200]["languages"]) == names[-5:] and sum(got[200]["shares"]) == pytest.approx(1)


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(25)]
        bad = int(i % 4 == 0)
        if bad:
            words[rng.randrange(25)] = "Scum!"
        rows.append((i, " ".join(words)))
        labels.append((i, bad, 1))
    rows += [(None, "scum"), (301, None), (302, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, score int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in held)
    assert 0 <= got[301]["score"] == got[302]["score"] <= 1
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_blocks_cover_all_rows():
    column = pa.array(["abc", None, "", "x" * 5000, "é"])
    seen = [(i, j, bytes(d[o[k] : o[k + 1]])) for i, j, d, o in blocks(column, 4) for k in range(j - i)]
    assert [s[2].decode() for s in seen] == ["abc", "", "", "x" * 5000, "é"]


def test_pipeline_against_the_operators(spark, tmp_path):
    import corpus_pipeline

    texts = [*corpus(11), "mail bob@mail.example.com please " + " ".join(f"u{i}" for i in range(60)), "1234"]
    item = " ".join(f"item{i}" for i in range(20))
    texts.append(f"before {item} after")
    make(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    letters = [i for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)]
    comp = near_brute([texts[i] for i in letters], letters, 5, 80)
    assert got == {i for i in letters if comp[i][1] == i and item not in texts[i]}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
