"""SentencePiece chunks, spelling variants and phrases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewind.llm import phrases as ph
from tidewind.llm import sentencepieces as sp
from tidewind.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


MODEL = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


def piece_rows(rows):
    out = []
    for doc, text in rows:
        ids = MODEL.encode(text or "", add_eos=True)
        out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD_TEXTS = [None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b ▁", "\n\t x\r\n", "ﬁ Ａ 日本語 🙂", "<s> </s> <0x0A> <unk>", "x" * 30_000, " " * 5_000, "a b " * 20_000, "null\0byte"]


@pytest.mark.parametrize("table_bytes", [sp.TABLE_BYTES, 300, 0])
def test_pieces_are_the_librarys(spark, table_bytes):
    rng = random.Random(table_bytes)
    words = ["".join(rng.choice("abcé ▁\n.") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(100 + k, " ".join(rng.choices(words, k=rng.randrange(80)))) for k in range(60)]
    rows += [(None, "no identifier here"), (3, "   "), (7, "again"), (7, "again"), (2**62 + 1, "big identifier")]
    docs = docs_of(spark, [(d, t, None, None) for d, t in rows]).withColumns({"key": F.lit("clash"), "own": F.lit(1), "chunk": F.lit("x")}).repartition(3)
    got = sp.encoded(docs, table_bytes=table_bytes, with_ids=True)
    assert sorted((tuple(r) for r in got.drop("ids", "decoded").collect()), key=repr) == piece_rows(rows)
    assert {r.doc_id: r.text for r in sp.decoded(got).collect() if r.doc_id == 100} == {r.doc_id: r.decoded for r in got.collect() if r.doc_id == 100}
    assert sp.encoded(docs.limit(0), table_bytes=table_bytes).count() == 0


def test_chunks_are_segmented_as_in_their_text():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(" ▁ab e\nthing\tﬁ日🙂\0<s>é.1") for _ in range(rng.randrange(30)))
        assert [i for ids in sp.segmented(MODEL, sp.chunks(text)) for i in ids] == MODEL.encode(text)


def test_models_that_cross_markers_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ("▁a", "b▁c")[i]

    with pytest.raises(ValueError, match="crosses"):
        sp.checked(Crossing())


def test_query_13_is_brute_force(spark, sf):
    from tidewind.llm import registry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op13_sentencepiece"](spark, sf).collect()), key=repr) == piece_rows(rows)


def test_only_repeated_chunks_are_in_the_table(spark):
    got = {r.chunk: r.n for r in sp.chunk_table(docs_of(spark, [(1, "a b  c", None, None), (2, "b c", None, None), (3, None, None, None), (4, "a", None, None)]), sp.default_model()).collect()}
    assert got == {"a": 2, "b": 2}


def test_entries_are_found_by_their_digest():
    own = [f"w{k}" for k in range(500)]
    ids = [list(range(k % 7)) for k in range(500)]
    edges = np.append(0, np.cumsum([len(x) for x in ids]))
    f = sp.Frequent(b"".join(map(sp.digest, own)), np.array([i for x in ids for i in x], "<u2"), edges)
    at = f.find(own + ["none"])
    assert at[-1] == -1 and [f.ids[f.edges[k] : f.edges[k + 1]].tolist() for k in at[:-1]] == ids


def edits(word, alphabet):
    """All words that one edit makes of a word."""
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + 1 :] for c in alphabet for k in range(len(word))}
    out |= {word[:k] + c + word[k:] for c in alphabet for k in range(len(word) + 1)}
    return out - {word}


def test_neighbourhoods_are_full_and_distinct(monkeypatch):
    monkeypatch.setattr(sv, "AT_ONCE", 64)
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(100)] + ["ab" * 90]
    alphabet, made = np.array(sorted(map(ord, "abéz")), np.uint32), {k: [] for k in range(len(words))}
    for edit, h, word, place, letter in sv.neighbours(words, alphabet):
        new = [sv.edited(words[w], edit, p, chr(alphabet[c])) for w, p, c in zip(word.tolist(), place.tolist(), letter.tolist(), strict=True)]
        for w, c in zip(word.tolist(), new, strict=True):
            made[w].append(c)
        full = [k for k, c in enumerate(new) if c]
        assert (sv.hashes([new[k] for k in full]) == h[full]).all()
    assert all(sorted(made[k]) == sorted(edits(w, "abéz")) for k, w in enumerate(words))


def brute_variants(rows, shortest=7, least=2, ratio=10, every=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if every is None or h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    alphabet, form, out = sorted({c for w in words for c in w}), {}, []
    for w, n in words.items():
        near = sorted((c for c in edits(w, alphabet) if c in words), key=lambda c: (-words[c], c))
        form[w] = (near[0] if near and words[near[0]] >= ratio * n else None, len(near))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], words.get(form[w][0])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bytes", [sv.FILTER_BYTES, 1])
def test_variants_against_brute_force(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(sv, "FILTER_BYTES", filter_bytes)  # 1: a filter of one segment
    rng = random.Random(9)
    rows = [(None, None), (1, ""), (2, "x" * 4_000 + " " + "x" * 4_000), (3, "x" * 3_999 + " " + "x" * 3_999), (4, "Über Ünder \u00d7\u00f7 123"), (4, "no ids here"), (None, "Straße straße STRASSE " * 5)]
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10))) for _ in range(6)]
    for k in range(300):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems)
            if rng.random() < 0.1:
                w = rng.choice(sorted(edits(w, "abcdéF")))
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((k, " ".join(words)))
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"]  # each form is another word's variant
    rows += [(5000 + k, " ".join(w for w, n in zip(chain, (2, 20, 200, 2000), strict=True) for _ in range(n // 2))) for k in range(2)]
    docs = docs_of(spark, [(d, t, None, None) for d, t in rows]).withColumns({"word": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    for every in (31, None):
        got = sv.spelling_variants(docs, every=every)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(rows, every=every)
    roots = {r.word: r.root for r in got.collect()}
    assert roots["aaaaaaa"] == roots["aaaabbb"] == "aaaabbb" and sv.spelling_variants(docs.limit(0)).count() == 0


def brute_phrases(rows, min_count, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {key: c for key, c in f.items() if c >= min_count}
    inside = {}
    for (lang, w), c in f.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(c, inside.get((lang, w[i:j]), 0))
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and inside.get((lang, w), 0) < a:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return sorted((lang, k, w.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for k, (score, a, w, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize(("part", "largest", "top"), [(1 << 21, 24, 2000), (40, 16, 5)])
def test_phrases_against_brute_force(spark, monkeypatch, part, largest, top):
    monkeypatch.setattr(ph, "PART", part)
    monkeypatch.setattr(ph, "LARGEST", largest)
    rng = random.Random(part)
    odd = [None, "", " \t ", "...!?", "one", "a  b\tc\x0bd", "x" * 5_000, "Ünï cödé \u00a0 A\u00a0B", "no end " * 3_000, "a, b; c: d! e? f\ng\rh\x0ci"]
    rows = [(t, lang) for t in odd for lang in ("en", None, "")]
    words = ["The", "the", "of", "é", "big", "cat", "sat", "日本", "on"]
    for k in range(250):
        text = "".join(rng.choice(words[: rng.randrange(2, 10)]) + rng.choice(["  ", " ", "\t", " ", " ", " ", ". ", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((text + "once upon a time there was", rng.choice(["en", "de", None, "und"])))
    docs = docs_of(spark, [(k, t, lang, None) for k, (t, lang) in enumerate(rows)]).withColumns({"phrase": F.lit("clash"), "f": F.lit(1), "k": F.lit(2)}).repartition(3)
    for least in (2, 12, 300):
        got = ph.collocations(docs, min_count=least, top=top)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and ph.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 9_876_543_210_987, 123_456_789_012, 345_678_901_234, 234_567_890_123
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, k int, f long")
    from tidewind.llm.common import shared_dir

    got = ph.scored(counts, spark.createDataFrame([("en", n)], "lang string, n long"), shared_dir(spark)).first()
    assert got.score == 1000 * a * n // (left * right) and 1000 * a * n > 1 << 64


def test_sketches_never_underestimate(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(400)) for _ in range(20)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    import pyarrow as pa

    for least in (100, 1_000):
        sketch = ph.sketched(docs, 3, least, f"{tmp_path}/{least}")
        top, true, of = np.iinfo(sketch.kind).max, Counter(), {}
        for first, words, own in ph.parts(pa.array(texts), 3):
            for n, h, whole in words.runs(3, np.repeat(ph._salts(["en"]), len(words.begin)), own):
                for k in np.flatnonzero(whole).tolist():
                    true[words.text(k, n)] += 1
                    of[words.text(k, n)] = h[k]
        est = sketch.estimate(np.array([of[t] for t in true], np.uint64))
        assert all(int(e) >= min(top, true[t]) for e, t in zip(est, true, strict=True)) and top >= least


def test_sketches_grow_with_the_text_and_are_counted_in_slices(spark, monkeypatch, tmp_path):
    assert ph.sketch_power(6 << 30) == 27 and ph.sketch_power(16 << 30) > 27  # as many cells for each byte as at 1 GB
    texts = [" ".join(f"w{k % 7} w{k * j % 50}" for k in range(60)) for j in range(40)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    whole = ph.sketched(docs, 3, 20, f"{tmp_path}/whole")
    monkeypatch.setattr(ph, "SLICE", ph.SMALLEST)
    monkeypatch.setattr(ph, "SMALLEST", ph.SMALLEST + 2)
    sliced = ph.sketched(docs, 3, 20, f"{tmp_path}/sliced")
    assert (whole.power, sliced.power) == (16, 18) and 0 < whole.bits.sum() and sliced.bits.nbytes == 2 << 15
    h = np.arange(1, 1 << 16, dtype=np.uint64) << np.uint64(32) | np.arange(1, 1 << 16, dtype=np.uint64)
    assert set(sliced.estimate(h).tolist()) <= {19, 255}
    assert sorted(map(tuple, ph.frequent(docs, sliced, 3, 20).collect()), key=str) == sorted(map(tuple, ph.frequent(docs, whole, 3, 20).collect()), key=str)
