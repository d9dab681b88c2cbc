"""Personal data, packing, page text, toxicity and the automaton against brute force, without Spark where it isn't needed."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewind.llm import decontamination as dc
from tidewind.llm import html_extraction as he
from tidewind.llm import near_dedup as nd
from tidewind.llm import packing, pii, tokens, toxicity
from tidewind.llm import substring_dedup as sd

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(n) <= 19 and pii.luhn(n)) or kind == "phone" and not 9 <= len(n) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@+-1203 4(5)9%é", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert sorted(pii.base(text)) == brute_base(text)


def test_more_spans_stand_beside_the_base_ones():
    text = "é +1 (269) 555-3296 4524132264652876 and GB82 WEST 1234 5698 7654 32, a (at) b (dot) org, ssn 123-45-6789"
    kinds = [(k, text[a:b]) for k, a, b, _, _ in pii.spans(text)]
    assert ("phone", "+1 (269) 555-3296") in kinds and ("card", "4524132264652876") in kinds and ("ssn", "123-45-6789") in kinds
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds and ("email", "a (at) b (dot) org") in kinds
    assert pii.redact("call +49 30 1234567 now") == "call <phone> now" and pii.redact(None) is None and pii.spans("") == []


def test_ibans_before_capitals_and_digits():
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"):
        for after in ("", ".", " BIC COBADEFFXXX", " Please pay", " 2024", " DE89370400440532013000", " GB82 WEST 1234 5698 7654 32"):
            text = f"IBAN {number}{after}"
            assert ("iban", 5, 5 + len(number)) in [s[:3] for s in pii.spans(text)] and pii.redact(text).startswith("IBAN <iban>")
    assert pii.redact("DE89370400440532013000 GB82WEST12345698765432") == "<iban> <iban>" and "<" not in pii.redact("IBAN DE88370400440532013000 BIC COBADEFFXXX")


def test_secrets_need_a_word_before_them():
    token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    for before in ('token = "', "api_key: ", "Authorization: Bearer ", "secret='", "| token = "):
        assert [s[:3] for s in pii.spans(f"x {before}{token}' y")] == [("secret", 2 + len(before), 42 + len(before))]
    assert not pii.spans(f"commit {token} fixes it") and not pii.spans("token = internationalisation_of_words") and pii.redact(f"key: {token}.") == "key: <secret>."


@pytest.mark.parametrize("seed", range(3))
def test_added_spans_against_brute_force(seed):
    """Planted numbers between words that are none: all that brute force confirms are found, and nothing else."""
    rng = random.Random(seed)

    def iban(good):
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check % 97) + 2 if check < 98 and (check % 97) + 2 != check else 3:02d}{body}"

    def card(good):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        last = next(d for d in "0123456789" if pii.luhn(body + d))
        return body + (last if good else str((int(last) + 1) % 10))

    words, planted = [], []
    for k in range(200):
        words.append(rng.choice(["nothing", "here", "é", "stands,"]))
        good, kind = rng.random() < 0.5, rng.choice(["iban", "card"])
        number = iban(good) if kind == "iban" else card(good)
        plain = number[4:] + number[:4]
        right = int("".join(str(int(c, 36)) for c in plain)) % 97 == 1 if kind == "iban" else sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(number[::-1])) % 10 == 0
        at = len(" ".join(words)) + 1
        words.append(number)
        if right:
            planted.append((kind, at, at + len(number)))
    found = [s[:3] for s in pii.spans(" ".join(words)) if s[0] in ("iban", "card")]
    assert [s for s in found if s[0] == "iban"] == [s for s in planted if s[0] == "iban"]
    assert {s for s in planted if s[0] == "card"} <= {s for s in found if s[0] == "card"}


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1 " * 100_000, "@" * 100_000, "DE12" + "A1" * 100_000, "token=" + "a1" * 150_000, "a1-" * 100_000])
def test_long_texts_take_linear_time(text):
    pii.spans(text)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_hits(items, text):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        b = words(body)
        k = min(13, len(b))
        for i in range(len(b) - k + 1) if b else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == b[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(w), hit, found


def test_automaton_finds_what_brute_force_finds():
    rng = random.Random(5)
    for _ in range(60):
        vocabulary = "a b c dé".split()[: rng.randint(1, 4)]
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        items = [(str(i), text(rng.randint(0, 30))) for i in range(6)]
        doc = text(rng.randint(0, 120))
        doc = doc + " " + rng.choice(items)[1].upper().replace("É", "é") + " " + text(5)
        a = dc.Automaton([(i, dc.words_of(t)) for i, t in items])
        found = set()
        hit, _ = a.hits(dc.words_of(doc), None, found)
        n, expected, expected_items = brute_hits(items, doc)
        assert len(dc.words_of(doc)) == n and {k for k, x in enumerate(hit or b"") if x} == expected and found == expected_items


def test_blocks_lose_no_window():
    items = [("x", " ".join(map(str, range(200)))), ("y", ""), (None, "a b"), ("z", "a")]
    parts = list(dc.blocks(iter(items), 40))
    assert {tuple(p[i : i + 13]) for b in parts for _, p in b for i in range(len(p) - 12)} == {tuple(str(k + j).encode() for j in range(13)) for k in range(188)}
    assert ("z", [b"a"]) in [i for b in parts for i in b]


def test_spans_are_cut_from_the_text():
    hit = bytes([0] * 2 + [1] * 13 + [0])
    text = "One two, " + " ".join(f"w{i}" for i in range(13)) + " end."
    assert dc.without(text, hit, 13) == "One two,  end." and dc.without(text, hit, 14) == text


def test_word_hashes_and_windows():
    import pyarrow as pa

    texts = ["a  b\tc", None, "", "x" * 10, "A b c " * 400_000, "é ü"]
    got = {}
    for first, end, h, edges in tokens.pieces(pa.array(texts), lower=True):
        for k in range(first, end):
            got[k] = h[edges[k - first] : edges[k - first + 1]]
    assert [len(got[k]) for k in range(6)] == [3, 0, 0, 1, 1_200_000, 2]
    assert (got[0] == got[4][:3]).all() and len(set(got[4].tolist())) == 3
    h = np.arange(40, dtype=np.uint64)
    for k in (1, 2, 7, 40, 41):
        assert len(tokens.rolling(h, k)) == max(0, 41 - k)
    words = pa.array(["a" * 5000 + " " + "a" * 9000 + " " + "a" * 5000 + " ba ab"])
    one, two = ([h for _, _, h, _ in tokens.pieces(words, kind=k)][0].tolist() for k in (0, 1))
    assert len(set(one)) == len(set(two)) == 4 and not set(one) & set(two) and one[0] == one[2]
    # a short word has the same hash beside a very long one
    assert [h for _, _, h, _ in tokens.pieces(pa.array(["ba ab"]))][0].tolist() == one[3:]


def test_bloom_filter_has_all_it_was_given():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 30_000)
    other = rng.integers(-(2**63), 2**63 - 1, 30_000)
    filter_ = np.zeros((2, sd.SEGMENT_BITS // 8), np.uint8)
    for k in range(2):
        bits = np.zeros(sd.SEGMENT_BITS, np.uint8)
        for at in sd._bits(h[h % 2 == k]):
            bits[at] = 1
        filter_[k] = np.packbits(bits)
    assert sd.may_hold(filter_, h).all() and sd.may_hold(filter_, other).mean() < 0.02


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.75, 0.9):
        got = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = round(600 * share)
            one, two = both[: n + (600 - n) // 2], np.concatenate((both[:n], both[n + (600 - n) // 2 :]))
            a, b = nd.signatures([np.unique(one), np.unique(two)])
            got.append(nd.estimate(int.from_bytes(nd.sketch(a), "big"), int.from_bytes(nd.sketch(b), "big")))
        assert abs(np.mean(got) - share) < 0.04


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    model, mine = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", "a", " a  b   c ", "x\n y\t z", "don't stop 123 !!", "<|endoftext|> a", "é à b  c", "a " * 50, "\n\n  x", "日本 語"]
    long = [" " * 9000, "a" + " " * 9000 + "b", "x" + "\n" * 5000 + " y" + " \t" * 4000 + "z", " " * 5000 + "\n", "a" * 20_000, "é" + "\u3000" * 4500 + "1"]
    for text in texts + long:
        assert np.frombuffer(mine(text), np.uint32).tolist() == model.encode(text, add_special_tokens=False).ids


def run_islands(lengths, capacity, epochs=packing.EPOCHS):
    """What the islands do, without Spark."""
    least, start = packing.least_bins(lengths, capacity), packing.best_fit_decreasing(lengths, capacity)
    rngs = [random.Random(i) for i in range(packing.ISLANDS)]
    islands = [packing.population(start, lengths, capacity, r) for r in rngs]
    for k in range(epochs):
        if k:
            elite = [p[0] for p in islands]
            islands = [[*p, e] for p, e in zip(islands, elite[-1:] + elite[:-1], strict=True)]
        islands = [packing.epoch(p, lengths, capacity, r, least) for p, r in zip(islands, rngs, strict=True)]
    return min((p[0] for p in islands), key=lambda p: p.score)


def fewest(lengths, capacity):
    """The exact optimum of a small input."""
    best, order = len(lengths), sorted(lengths, reverse=True)

    def place(k, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if k == len(order):
            best = len(fill)
            return
        for f in {f: None for f in fill if f + order[k] <= capacity}:
            rest = list(fill)
            rest[rest.index(f)] += order[k]
            place(k + 1, rest)
        place(k + 1, [*fill, order[k]])

    place(0, [])
    return best


def test_packings_are_whole_and_tight():
    rng = random.Random(1)
    for low, high in ((1, 1023), (200, 500), (256, 512), (5, 60)):
        lengths = [rng.randint(low, high) for _ in range(1500)]
        plain, found = packing.best_fit_decreasing(lengths), run_islands(lengths, 1024)
        exact = packing.fill_exactly(lengths, 1024, rng)
        for packed in (plain, found, exact):
            assert sorted(p for b in packed.bins for p in b) == list(range(1500)) and all(sum(lengths[p] for p in b) == f <= 1024 for b, f in zip(packed.bins, packed.fill, strict=True))
        assert packing.least_bins(lengths) <= len(found.bins) <= len(plain.bins)
        if low in (200, 256):
            assert len(found.bins) < 0.97 * len(plain.bins)
    assert packing.least_bins([512] * 10) == 5 and packing.least_bins([]) == 0 and packing.least_bins([600] * 7 + [1]) == 7
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)] and packing.cut(1) == [(0, 1)]


def test_islands_reach_the_optimum_of_small_inputs():
    rng, missed = random.Random(8), 0
    for _ in range(40):
        capacity = 30
        lengths = [rng.randint(4, 16) for _ in range(12)]
        best = fewest(lengths, capacity)
        assert packing.least_bins(lengths, capacity) <= best == len(run_islands(lengths, capacity).bins)
        missed += len(packing.best_fit_decreasing(lengths, capacity).bins) > best
    assert missed  # by the plain pass


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><header><h1>Big &amp; small</h1></header><p>One <b>bold</b>
 word.<br><p>Two &eacute;<form><input><button>Go</button></form></p><aside>See also</aside><ul><li>a<li>b</ul><section class="comments"><p>First!</p></section></article><footer>&copy; me</footer>"""


def test_main_text():
    assert he.main_text(PAGE) == "Big & small\n\nOne bold word.\n\nTwo é\n\na\n\nb"
    assert he.main_text(None) == he.main_text("") == "" and he.main_text("<p>only text") == "only text"
    assert he.main_text("<div><p>long text of a page that stands alone</p><p>and more</p></div><nav>x</nav>") == "long text of a page that stands alone\n\nand more"


def test_main_text_without_an_article_element():
    parts = ["Head", "First paragraph of it.", "one", "two", "A quotation.", "Of a section.", "Linked words"]
    body = "<h2>{}</h2><p>{}</p><ul><li>{}<li>{}</ul><blockquote><p>{}</p></blockquote><section><p>{}</p><p><a href=x>{}</a></p></section>".format(*parts)
    page = f"<body><div class=top><a href=y>Elsewhere</a></div><div>{body}</div><footer>x</footer></body>"
    assert he.main_text(page) == "\n\n".join(parts)
    assert he.main_text("<div><section><p>A short one.</p></section><section><p>A section that is longer.</p></section></div>") == "A short one.\n\nA section that is longer."
    assert he.main_text("<div><a href=x>All links</a></div>") == "All links"


@pytest.mark.parametrize(
    "wrap",
    ["<div class='layout no-sidebar'>{}</div>", "<div class='content-with-sidebar'>{}</div>", "<div class='post comments-open'>{}</div>", "<div class='has-banner site'>{}</div>", "<div id=main class='main side'>{}</div>",
     "<div class='search-results-off page'>{}</div>", "<form id=aspnetForm>{}</form>", "<div class=sidebar>{}</div>"],
)
def test_what_holds_the_article_is_kept(wrap):
    article = "<h2 class='share price'>Prices</h2><p class=notice>Take notice.</p><div class='side by side'><p>Text</p></div>"
    out = "Prices\n\nTake notice.\n\nText"
    tail = "<div class=cookie-notice>Cookies</div><section class=comments><article class=comment><p>First!</p></article></section>"
    assert he.main_text(wrap.format(f"<article>{article}<p class=share-links><a href=x>Share this</a></p><div class='ad-box'>Buy</div></article>") + tail) == out
    assert he.main_text(wrap.format(f"<div>{article}</div>") + "<footer>x</footer>").endswith("Text")


@pytest.mark.parametrize("text", ["<p>" * 50_000, "<div>" * 50_000 + "x", '<a href="' * 50_000, "<!--" * 50_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "</b>" * 50_000, "<script>" * 20_000])
def test_broken_pages_end(text):
    he.main_text(text)


def test_disguised_words_are_restored():
    rng = random.Random(2)
    clean = ["the nice house stands there", "a stone and a stand near the idle house", "this man lost his other coat"]
    bad = ["idiot", "moron", "stupid", "pathetic"]
    texts = [(0, rng.choice(clean) + " " + rng.choice(clean)) for _ in range(200)] + [(1, rng.choice(clean) + " " + " ".join(rng.sample(bad, 2))) for _ in range(100)]
    total = sum((toxicity._trigrams([t]) for _, t in texts), np.zeros(toxicity.SYMBOLS**3))
    three = total.reshape(*[toxicity.SYMBOLS] * 3)
    cost = -np.log((three + 0.1) / (three.sum(2, keepdims=True) + 0.1 * toxicity.SYMBOLS)).astype(np.float32)
    channel = toxicity.Channel(cost)
    assert channel.decode("m0r0n") == "moron" and channel.decode("s t u p i d") == "stupid" and "idiot" in channel.words("idiiiiot") and channel.words("house,") == ("house",)
    assert "idiot" in channel.words("idiiot") and "stupid" in channel.words("stuupid") and "moron" in channel.words("mo-ron")
    spaced = {"m o r": "mor", "m  o  r  o  n": "moron", "$ t u p i d": "stupid", "you $ t . . u": "stu", "i.d.i.o.t": "idiot"}
    assert all(word in channel.restore(text) for text, word in spaced.items()), [channel.restore(t) for t in spaced]
    model = toxicity.Model(cost, *toxicity.fit([(y, sorted(channel.restore(t))) for y, t in texts]))
    assert model.score("the nice house m0r0n and s t u p i d") > 0.5 > model.score("a nice house") and 0 <= model.score(None) == model.score("") < 0.5


def test_decoding_finds_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    cost = rng.uniform(0.1, 6, [toxicity.SYMBOLS] * 3).astype(np.float32)
    channel = toxicity.Channel(cost)

    def total(path, costs):
        a = b = 0
        out = sum(costs)
        for c in path:
            s = toxicity._symbol(ord(c))
            out += float(cost[a, b, s])
            a, b = b, s
        return out + float(cost[a, b, 0])

    for word in ("m0r0n", "a$$", "iddiot", "1d!ot", "h3ll0", "sh!7", "f-o-o", "6oo"):
        readings = [[]]
        for here in toxicity.lattice(word):
            readings = [[*r, x] for r in readings for x in here]
        best = min(readings, key=lambda r: total([c for c, _ in r if c], [n for _, n in r]))
        least = total([c for c, _ in best if c], [n for _, n in best])
        got = channel.decode(word)
        among = [r for r in readings if "".join(c for c, _ in r) == got]
        assert min(total([c for c, _ in r if c], [n for _, n in r]) for r in among) == pytest.approx(least, abs=1e-4)


def test_scores_are_those_of_all_restored_words():
    rng = np.random.default_rng(5)
    cost = rng.uniform(0.1, 6, [toxicity.SYMBOLS] * 3).astype(np.float32)
    channel = toxicity.Channel(cost)
    words = "idiot moron stupid foo aa sheep ass llama pathetic otter zz".split()
    weights = {f: float(w) for f, w in zip((f for word in words[::2] for f in toxicity.features(word)), rng.normal(size=40), strict=False)}
    model, pick = toxicity.Model(cost, weights, -0.3), random.Random(4)
    change = [lambda w: w, lambda w: w + pick.choice(".,;:"), lambda w: re.sub(f"([{pick.choice('aeiost')}])", r"\1\1\1", w), lambda w: w.replace("o", "0").replace("i", "!"), lambda w: " ".join(w), lambda w: w[0] + w, lambda w: w.upper() + "...", lambda w: f"({w})"]
    for _ in range(400):
        text = " ".join(pick.choice(change)(pick.choice([*words, "otherwise", "llano", "aardvark", "x1y"])) for _ in range(6))
        x = -0.3 + sum(weights[f] for f in {f for w in channel.restore(text) for f in toxicity.features(w)} if f in weights)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-x)))


def test_what_is_remembered_is_bounded():
    from tidewind.llm.common import Remembered

    known = Remembered(10_000, 10)
    for k in range(5_000):
        assert known.put(f"w{k}", (f"w{k}",)) == (f"w{k}",)
        known.put("x" * 100 + str(k), b"y" * 1000)
        assert known["w0"] == ("w0",)  # what is asked for often stays
    assert 0 < len(known) + len(known.old) < 60 and all(len(k) <= 10 for k in known) and known["w1"] is None


def test_fit_without_both_labels():
    assert toxicity.fit([]) [0] == {} and toxicity.fit([(0, ["a"])])[0] == {}
    assert zlib.crc32(b"5") % 5 in range(5)
