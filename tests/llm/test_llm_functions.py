"""The parts of the operators that need no session, against plain versions or the libraries themselves."""

import random
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, decontam, elias_fano, hmm, hnsw, minhash, quality, spans, suffix, token_store, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "I'll don't 's", "<|endoftext|>", "x<|startoftext|>Y z<|endoftext|>", "ΑΣ ΣΑΣ", "İx", "é", "a\x1cb\x1f c", "a b​c\x85d", "😀 你好１２ ½²", "A" * 70 + "b" * 100, "the" * 3000, "x" * 65, "y" * 64, "ǅ ß ẞ ﬁ", "Ω K", "\x00\x01", "a_b__c"]


def same_as_library(texts):
    own, kept = bpe.tokenizer(PATH), token_store.encoder(PATH)
    for t, ids, short in zip(texts, own.encode_texts(texts), kept.encode(texts), strict=True):
        expected = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert np.frombuffer(short, kept.kind).tolist() == expected
        assert own.decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_bpe_like_the_library_on_odd_texts():
    same_as_library(ODD)


def test_token_store_like_the_library_on_every_code_point():
    """Alone, and between letters."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    kept = token_store.LibraryEncoder(PATH)
    for k in range(0, len(points), 4000):
        text = " ".join(f"{chr(c)} x{chr(c)}y" for c in points[k : k + 4000])
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(kept.encode([text])[0], kept.kind).tolist() == expected, hex(points[k])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_like_the_library(texts):
    same_as_library(texts)


def test_bpe_cache_turns_over():
    small = bpe.WordBpe(PATH)
    small.known.most = 5
    texts = [" ".join(f"word{k} {k}" for k in range(n, n + 9)) for n in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in small.encode_texts([t])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano(gaps):
    values = np.cumsum(gaps)
    coded = elias_fano.EliasFano(elias_fano.encode(values))
    assert coded.values().tolist() == values.tolist()
    assert [coded.select(k) for k in range(0, len(values), 7)] == values[::7].tolist()
    for a in range(0, len(values), 97):
        for b in (a, min(len(values), a + 300), len(values)):
            assert coded.selects(a, b).tolist() == values[a:b].tolist()
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 500))
    assert len(elias_fano.encode(values)) < 10_000 * 2


def test_token_file(tmp_path):
    docs = [np.arange(k, dtype="<u2").tobytes() for k in (3, 0, 5)]
    (tmp_path / "a").write_bytes(token_store.pack([None, -4, 7], docs, 2))
    file = token_store.TokenFile(f"file://{tmp_path}/a")
    assert [file.document(k).tolist() for k in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]] and [file.doc_id(k) for k in range(3)] == [None, -4, 7]


def brute_hits(text, items, window=10):
    words, own = decontam.words_of(text), [(i, decontam.words_of(t)) for i, t in items]
    hit, found = set(), set()
    for i, w in own:
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(words), sorted(hit), sorted(found)


def test_aho_corasick_against_windows():
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice(["a", "b", "É", "c.", "C", "don't"]) for _ in range(n))
    items = [(str(k), draw(rng.randint(0, 14))) for k in range(30)] + [("x", "")]
    built = decontam.Benchmark(items, 3)
    for n in range(60):
        text = draw(n)
        words = decontam.words_of(text)
        hit, own = built.scan(words)
        assert (len(words), hit.tolist(), sorted(own)) == brute_hits(text, items, 3)


def test_spans_point_at_the_original():
    text = "Wer? über--die brÜCKE gehen! nein (über die brÜcke, gehen)"
    words = decontam.words_of(text)
    hit, _ = decontam.Benchmark([("1", "über die brÜCKE gehen")]).scan(words)
    n, hit = len(words), hit.tolist()
    assert n == 10 and [text[a:b] for a, b in decontam.char_spans(text, hit)] == ["über--die brÜCKE gehen", "über die brÜcke, gehen"]


@pytest.mark.parametrize("n", [1, 2, 5, 40, 127, 128, 500, 5000])
def test_sketches_fill_and_estimate(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    s = minhash.sketch(a)
    assert len(s) == minhash.BINS and (s < np.uint64(2**64 - 1)).all() and (minhash.sketch(a[::-1]) == s).all()
    if n >= 40:
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.sketch(b) == s).mean() - true) < 0.2


def test_shingles():
    s = minhash.Shingler(2)
    assert len(s("a b A B")) == 2 and len(s("a")) == 1 and len(s(" \t")) == 0 and (s("x\x0by") == s("X y")).all()


def brute_lpf(docs, length):
    first = {}
    for d, text in docs:
        for p in range(len(text) - length + 1):
            k = text[p : p + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, text in docs:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(text, gone, strict=True) if not g))
    return out


def test_suffix_matches_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        docs = [(k // 2, bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))) for k in range(6)]
        length = 12
        block = suffix.Block([d for d, _ in docs], [t for _, t in docs], length)
        use = np.ones(len(docs), bool)
        name, at, count, _ = block.runs(use)
        valid = sum(max(0, len(t) - length + 1) for _, t in docs)
        assert count.sum() == valid and len(name) == len(at)
        raw = np.frombuffer(b"".join(block.raw[s : s + n + length - 1].tobytes() for s, n in zip(at, count, strict=True)), np.uint8)
        sizes = count + length - 1
        hit = suffix.matches(block.doc_of(at), sizes, raw, length) if len(at) else np.zeros(0, bool)
        spans_, start = [], 0
        for s, n in zip(at.tolist(), sizes.tolist(), strict=True):
            spans_ += [(s + k, s + k + length) for k in np.flatnonzero(hit[start : start + n]).tolist()]
            start += n
        kept, _, _ = suffix.cut_out(block, np.array(spans_, np.int64).reshape(-1, 2), np.zeros(len(docs), bool))
        ordered = [docs[k] for k in block.order]
        assert kept == brute_lpf(ordered, length)


def test_equal_windows_have_equal_names():
    text = b"some words that are in two documents, and more of them to be long enough"
    b = suffix.Block([1, 2], [b"xx" + text, text + b"yyy"])
    name, at, count, doc = b.runs(np.ones(2, bool))
    window = lambda p: b.raw[p : p + 50].tobytes()
    by = {}
    for n, s, c in zip(name.tolist(), at.tolist(), count.tolist(), strict=True):
        for p in range(s, s + c):
            assert by.setdefault(window(p), n) == n
    assert set(doc.tolist()) == {0, 1}


def test_suffix_pieces_find_what_the_whole_does(monkeypatch):
    rng = random.Random(7)
    docs = [(k, bytes(rng.choice(b"ab") for _ in range(200))) for k in range(40)]

    def found(piece):
        monkeypatch.setattr(suffix, "PIECE_BYTES", piece)
        block = suffix.Block([d for d, _ in docs], [t for _, t in docs], 12)
        name, at, count, doc = block.runs(np.ones(len(docs), bool))
        short, sizes, out = (name >> np.uint64(32)).astype(np.int64), count + 11, set()
        pieces = suffix.pieces_of(short, sizes)
        assert sorted(np.concatenate(pieces).tolist()) == list(range(len(at)))
        for own in pieces:
            raw = np.frombuffer(b"".join(block.raw[s : s + n].tobytes() for s, n in zip(at[own], sizes[own], strict=True)), np.uint8)
            run, first, last = suffix.spans_of(block.ids[doc[own]], at[own], sizes[own], raw, 12)
            out |= set(zip(own[run].tolist(), first.tolist(), last.tolist(), strict=True))
        return len(pieces), [x.tolist() for x in (name, at, count, doc)], out

    whole, some = found(1 << 18), found(150)
    assert whole[0] == 1 < some[0] and whole[1:] == some[1:] and whole[2]


def test_suffix_memory_does_not_grow_with_what_repeats():
    """Sorting all suffixes of a bucket at once took over 80 bytes for each of its bytes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    base = [rng.integers(97, 123, 2000, np.uint8) for _ in range(200)]
    texts = []
    for k in range(1600):
        x = base[k % 200].copy()
        x[rng.integers(0, 2000, 20)] = 46
        texts.append(x.tobytes())
    block = suffix.Block(list(range(len(texts))), texts)
    use = np.ones(len(texts), bool)
    tracemalloc.start()
    name, at, count, doc = block.runs(use)
    most = [tracemalloc.get_traced_memory()[1]]
    sizes = count + 49
    for own in suffix.pieces_of((name >> np.uint64(32)).astype(np.int64), sizes):
        raw = np.frombuffer(b"".join(block.raw[s : s + n].tobytes() for s, n in zip(at[own], sizes[own], strict=True)), np.uint8)
        tracemalloc.reset_peak()
        suffix.spans_of(block.ids[doc[own]], at[own], sizes[own], raw, 50)
        most.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.reset_peak()
    suffix.cut_out(block, np.zeros((0, 2), np.int64), np.zeros(len(texts), bool))
    most.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert max(most) < 25 * block.size


def test_sentences_join_to_the_text():
    for t in ["", "A b. C d! E", "one\n\n two. ", "w " * 55 + "end. Next", "no end", "...", "a.b.c"]:
        assert "".join(spans.sentences(t)) == t
    assert all(len(s.split()) <= spans.PIECE for s in spans.sentences("w " * 95))


def test_long_passages_are_covered_whole():
    rng = random.Random(1)
    for _ in range(30):
        passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) + str(rng.randint(0, 9)) for _ in range(rng.randint(51, 120))) + "."
        b = spans.Block([1, 2], [f"first here.\n{passage}\nother text of this one.", f"unlike that.\n{passage}\nand so on it goes."])
        gone = b.removed(np.zeros(0, np.uint64))
        assert not gone[0].any()
        kept = "".join(p for p, g in zip(b.parts[1], gone[1], strict=True) if not g)
        assert kept == "unlike that.\nand so on it goes."


def kept_of_second(one, two):
    b = spans.Block([1, 2], [one, two])
    return "".join(p for p, g in zip(b.parts[1], b.removed(np.zeros(0, np.uint64))[1], strict=True) if not g)


def test_passages_inside_of_sentences_are_found():
    rng = random.Random(3)

    def words(n, kind, stops=0.0):
        return " ".join(kind + str(rng.randint(0, 999)) + ("." if rng.random() < stops else "") for _ in range(n))

    for k in range(300):
        passage = words(50, "p", 0.1 * (k % 3))
        kept = kept_of_second(f"{words(rng.randint(0, 30), 'a')} {passage} {words(rng.randint(0, 30), 'b')}", f"{words(rng.randint(0, 30), 'c')} {passage} {words(rng.randint(0, 30), 'd')}")
        assert sum(w.startswith("p") for w in kept.split()) <= 25 and not any(w in passage.split() for w in kept.split() if w[0] != "p")


def test_short_sentences_and_scripts_without_spaces_have_spans():
    assert kept_of_second("One here. Yes. No. Maybe. Two.", "Other start. Yes. No. Maybe. An end.") == "Other start. An end."
    rng = random.Random(4)
    passage = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60))
    assert len(kept_of_second("\u4e00\u4e01" + passage + "\u4e02\u3002", "\u4e03" + passage + "\u4e04\u4e05\u3002")) <= 25 + 3


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    t = quality.Trees().fit(x[:1500], y[:1500])
    assert ((t.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert (quality.Trees().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))) == 0.5).all()
    assert len(quality.statistics("")) == len(quality.statistics("Some text!\n\nMore | of it")) == len(quality.FEATURES)


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(500):
        t = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(t))
        rows.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    index = toxicity.BlockMaxIndex(rows, 40)
    dense = np.zeros((500, 40))
    for k, r in enumerate(rows):
        dense[k, list(r)] = list(r.values())
    for _ in range(50):
        q = rng.choice(40, 4, replace=False)
        w = rng.random(4)
        ids, scores = index.top(q, w, 15)
        every = dense[:, q] @ w
        best = np.lexsort((np.arange(500), -every))[:15]
        assert np.allclose(scores, every[best][: len(scores)]) and np.allclose(every[ids], scores)


def test_block_max_is_exact_where_bounds_decide():
    rng = np.random.default_rng(5)
    scale = np.concatenate([np.full(60, 0.01), np.ones(600)])
    dense = np.where(rng.random((700, 660)) < np.concatenate([np.full(60, 0.8), np.full(600, 0.02)]), rng.random((700, 660)), 0) * scale
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    index = toxicity.BlockMaxIndex([{int(t): float(r[t]) for t in np.flatnonzero(r)} for r in dense], 660)
    for q in dense[:40]:
        t = np.flatnonzero(q)
        ids, scores = index.top(t, q[t], 15)
        every = dense @ q
        assert np.allclose(scores, np.sort(every)[::-1][:15]) and np.allclose(every[ids], scores)


def test_terms_are_counted_as_one_by_one_and_unknown_words_are_held_once():
    from collections import Counter

    known = sorted({t for w in toxicity.words_of("alpha alphabet Grüße größer beta") for t in toxicity.terms_of(w)})
    model = toxicity.Model(b" ".join(known), np.ones(len(known)), 1.0)
    texts = ["alpha alphas ALPHA beta", "", "größte Grüße grünlich zebra zebras zebra ab abcd abcde", "日本語日本語 日本語日本誌 alphabet gros"]
    for texts in (texts, texts[::-1], [" ".join(texts)]):
        of, own, counts = model.counts(texts)
        for k, x in enumerate(texts):
            plain = Counter(t for w in toxicity.words_of(x) for t in toxicity.terms_of(w))
            mine = dict(zip(own[of == k].tolist(), counts[of == k].tolist(), strict=True))
            assert {known[t]: n for t, n in mine.items() if t < len(known)} == {t: n for t, n in plain.items() if t in known}
            assert sorted(n for t, n in mine.items() if t >= len(known)) == sorted(n for t, n in plain.items() if t not in known)
            assert list(mine) == sorted(mine)
    words = set(toxicity.words_of(" ".join(texts)))
    assert len(model.others) == len({t for w in words for t in toxicity.terms_of(w)[1:]} - set(known))


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    k, c = hmm.STATES, hmm.CLASSES
    emit = rng.random((c, k))
    model = hmm.Model(np.full(k, 1 / k), (lambda m: m / m.sum(1, keepdims=True))(rng.random((k, k))), emit / emit.sum(0))
    docs = [rng.integers(0, c, n).astype(np.int32) for n in (1, 2, 3, 3)]
    got = np.zeros(len(docs))
    for part, lengths, seen in hmm.batches_of(docs):
        got[part] += hmm.forward(model, lengths, seen)
    from itertools import product

    for d, g in zip(docs, got, strict=True):
        total = 0.0
        for path in product(range(k), repeat=len(d)):
            p = model.start[path[0]] * model.emit[d[0], path[0]]
            for a, b, x in zip(path, path[1:], d[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert abs(g - np.log10(total)) < 1e-9


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(6)
    docs = [(rng.integers(0, 20, 30) + 100 * (n % 3)).astype(np.int32) for n in range(60)]
    model, before = hmm.Model.seeded(hmm.groups_of(docs[:30]), 100.0), -np.inf
    for _ in range(3):
        score = sum(hmm.forward(model, lengths, seen).sum() for _, lengths, seen in hmm.batches_of(docs))
        assert score > before - 1e-6
        before = score
        sums = hmm.zeros()
        hmm.expected(model, docs, sums)
        assert abs(sums[3][0] - score) < 1e-6
        assert abs(sums[2].sum() - 60 * 30) < 1e-6 and abs(sums[0].sum() - 60) < 1e-6
        model = hmm.Model.of_counts(*sums[:3], 10.0)


def test_documents_of_unlike_words_are_grouped_apart():
    rng = np.random.default_rng(9)
    docs = [(rng.integers(0, 20, 60) + 30 * (n % 3)).astype(np.int32) for n in range(90)]
    groups = hmm.groups_of(docs)
    of_kind = np.stack([groups[:, 30 * k : 30 * k + 20].sum(1) for k in range(3)], 1)
    assert groups.sum() == 90 * 60 and ((of_kind > 0).sum(1) <= 1).all()
    again = hmm.united(np.concatenate([hmm.groups_of(docs[:45]), hmm.groups_of(docs[45:])]))
    assert np.allclose(again.sum(0), groups.sum(0))


def test_prior_follows_unseen_counts():
    rng = np.random.default_rng(10)
    share = np.r_[np.full(50, 0.015), np.full(hmm.CLASSES - 50, 0.25 / (hmm.CLASSES - 50))]
    draw = lambda n: np.stack([np.bincount(rng.choice(hmm.CLASSES, n, p=share), minlength=hmm.CLASSES) for _ in range(hmm.STATES)], 1).astype(float)
    # states that do not differ need a large prior, those that do a small one
    alike = hmm.deleted(draw(300), draw(300))
    apart = np.zeros((hmm.CLASSES, hmm.STATES))
    for k in range(hmm.STATES):
        apart[100 * k : 100 * k + 100, k] = 50
    assert hmm.deleted(apart, apart) < alike

def test_graph_recall_against_brute_force():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((800, 32)).astype(np.float32)
    near = base[rng.integers(0, 40, 400)] + 0.05 * rng.standard_normal((400, 32)).astype(np.float32)
    v = np.concatenate([base, near]).astype(np.float32)
    g = hnsw.Graph(v, np.arange(len(v)), np.ones(len(v), np.int64))
    g.audit(0.95)
    assert g.recall >= hnsw.RECALL
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    exact = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    found = g.linked(v, np.arange(len(v)), 0.95)
    hits = sum(len(set(g.ids[f]) & set(np.flatnonzero(e))) for f, e in zip(found, exact, strict=True))
    assert hits >= 0.99 * exact.sum() and sum(map(len, found)) == hits
    g.unite(0.95)
    assert (hnsw.Graph.load(g.save()).roots == g.roots).all()


def test_nodes_without_in_links_and_failed_audits_are_scanned():
    rng = np.random.default_rng(8)
    v = (rng.standard_normal(16) + 0.05 * rng.standard_normal((300, 16))).astype(np.float32)
    g = hnsw.Graph(v, np.arange(300), np.ones(300, np.int64))
    g.links[0][g.links[0] == 7] = -1
    g = hnsw.Graph.load((setattr(g, "roots", np.arange(300)), g.save())[1])
    assert all(7 in f for f in g.near(g.space, 0.9) if len(f) > 1)
    g.links[0][:] = -1
    g.lost = g.lost[:0]
    g.audit(0.95)
    assert g.recall >= hnsw.RECALL and g.exact


def test_a_member_of_a_family_that_few_links_lead_to_is_found_by_the_first_beam():
    rng = np.random.default_rng(3)
    family = rng.standard_normal(48) + 0.2 * rng.standard_normal((140, 48))
    v = np.concatenate([rng.standard_normal((600, 48)), family]).astype(np.float32)
    g = hnsw.Graph(v, np.arange(740), np.ones(740, np.int64))
    for member in np.flatnonzero(g.ids >= 600)[-5:].tolist():
        links = g.links[0].copy()
        aside = rng.standard_normal(48)
        aside -= (aside @ g.space[member]) * g.space[member]
        probe = (0.951 * g.space[member] + np.sqrt(1 - 0.951**2) * aside / np.linalg.norm(aside)).astype(np.float32)
        nearer = np.argsort(-(g.space @ probe))
        assert (g.space[nearer[: hnsw.FIRST_BEAM]] @ probe < 0.95).sum() > hnsw.FIRST_BEAM // 2
        links[links == member] = -1
        links[nearer[135], 0] = member  # the only one: a member behind the beam's end
        kept, g.links[0] = g.links[0], links
        assert g.beam == hnsw.FIRST_BEAM and member in g.near(probe[None], 0.9499)[0]
        g.links[0] = kept


def test_a_link_found_from_one_side_counts_for_both():
    one = hnsw.both_ends(1, 2, np.array([5, 9]), np.array([1, 4]))
    other = hnsw.both_ends(5, 1, np.array([1]), np.array([2]))
    assert [x.tolist() for x in hnsw.totals(np.concatenate([one, other]))] == [[1, 5, 9], [5, 2, 2]]


@pytest.mark.parametrize("size", [10, 300, 2000])
def test_families_of_near_copies_against_exact_products(size):
    rng = np.random.default_rng(size)
    base = rng.standard_normal((1500, 48))
    family = rng.standard_normal(48) + 0.12 * rng.standard_normal((size, 48))
    v = np.concatenate([base, family]).astype(np.float32)
    g = hnsw.Graph(v, np.arange(len(v)), np.ones(len(v), np.int64))
    g.audit(0.95)
    assert g.recall >= hnsw.RECALL
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    exact = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    links = g.linked(v, np.arange(len(v)), 0.95)
    both = np.zeros(exact.shape, bool)
    for k, found in enumerate(links):
        both[k, g.ids[found]] = True
    assert exact.sum() > size and not (both & ~exact).any() and (both | both.T)[exact].mean() > 0.9999


def plain_boosting(x, y, trees, depth, bins, rate, least, l2):
    """Boosted trees by trying every cut of every feature; gives the probabilities of the rows it is fitted on."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    margin = np.full(n, np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [np.arange(n)]
        for _ in range(depth):
            nxt = []
            for rows in leaves:
                best = (1e-9, None)
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                for f in range(width):
                    for c in cuts[f]:
                        a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if min(len(a), len(b)) >= least and len(rows) >= 2 * least:
                            gain = worth(a) + worth(b) - worth(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (a, b))
                nxt += list(best[1]) if best[1] else [rows]
            leaves = nxt
        for rows in leaves:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-margin))


def test_trees_against_plain_boosting_and_plain_traversal(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 6)
    monkeypatch.setattr(quality, "DEPTH", 2)
    rng = np.random.default_rng(12)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.4) | (rng.random(300) < 0.1)).astype(float)
    model = quality.Trees().fit(x, y)
    got = model.predict(x)
    assert np.allclose(got, plain_boosting(x, y, 6, 2, quality.BINS, quality.RATE, quality.LEAST_ROWS, quality.L2))
    for row, p in zip(x[:50], got, strict=False):
        margin = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.cut[node] else model.right[node]
            margin += model.value[node]
        assert abs(1 / (1 + np.exp(-margin)) - p) < 1e-12
