"""The operators on Spark: against SQL, against brute force, and on odd tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewind.llm import packing, registry
from tidewind.llm.components import components
from tidewind.llm.decontamination import decontaminate
from tidewind.llm.exact_dedup import exact_dedup, false_hits, keyed, ledger, located
from tidewind.llm.html_extraction import extract, parsed, read, template
from tidewind.llm.line_dedup import line_dedup
from tidewind.llm.near_dedup import near_dedup
from tidewind.llm.packing import pack_documents, sequences, tokenized
from tidewind.llm.pii import find_pii
from tidewind.llm.substring_dedup import substring_dedup
from tidewind.llm.toxicity import toxicity, without_toxic
from tidewind.llm.warc_archive import export_files, read_records, reconstruct, write_archive

DOCS = "doc_id long, text string, source string, n_chars long, digest string, h long, doc string, key long, length long, n string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "x", 1, "y", 2, 3, "z") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "b"), (3, " \n ", None), (None, "alone", "a"), (None, None, None), (4, "same text", "a"), (4, "same text", "a"), (5, "same  text", "c"), (2**60 + 1, "é" * 5, "a"), (6, "long word " * 3000, "b")]
SPACES = r"[\x20\x09-\x0D]"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_their_sql(name, same):
    assert same(registry.QUERIES[name], registry.SQL[name]) > 0


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_exact_dedup_on_odd_rows(spark, odd, none):
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(ODD) and exact_dedup(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by[4]] == [(5, 3, False)] * 2 and by[5][0].kept and by[1][0].keep_id == 3 and by[1][0].group_size == 4
    assert by[2**60 + 1][0].kept and by[2**60 + 1][0].text_sha256 == hashlib.sha256(("é" * 5).encode()).hexdigest()


def test_exact_dedup_follows_locators(spark, odd, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own, copied = located(docs, str(tmp_path)), located(odd.select("doc_id", "text"), str(tmp_path))
    assert own.where("file LIKE '%documents.parquet%'").select("file", "row").distinct().count() == docs.count() and copied.count() == len(ODD)
    rows = ledger(own)
    # a digest that two different texts share is found by following their locators
    one = rows.limit(1).select("digest").first().digest
    wrong = rows.withColumn("digest", F.when(F.col("row") < 3, F.lit(one)).otherwise(F.col("digest")))
    hits = keyed(wrong).where("n > 1")
    assert [r.digest for r in false_hits(own, wrong, hits, f"{tmp_path}/x").collect()] == [one]
    assert false_hits(own, rows, keyed(rows).where("n > 1"), f"{tmp_path}/y").count() == 0


def test_line_dedup_on_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in line_dedup(odd).collect()}
    assert line_dedup(odd).columns == [*odd.columns, "n_lines", "n_removed"] and line_dedup(none).count() == 0
    assert rows[1].text is None and rows[1].n_lines == 0 and rows[2].n_lines == 1 and rows[4].text == "same text"
    assert line_dedup(odd.withColumn("n_lines", F.lit("x"))).select("n_lines", "n_removed").count() == len(ODD)
    block = "Follow us\nAll rights reserved\n  Printed on paper\nVisit again\nThe end"
    rows = [(k, f"own {k}\n{block}\n" + "\n".join(f"more {k} {j}" for j in range(6)), f"s{k % 12}") for k in range(24)]
    rows += [(100 + k, "copied\ntext here\nend", f"s{k % 12}") for k in range(24)] + [(200 + k, f"copied\ntext here\nend {k}\nFollow us", f"s{k % 12}") for k in range(24)]
    rows += [(300 + k, f"nine sites\nrow {k}", f"s{k % 9}") for k in range(30)]
    spread = docs_of(spark, rows)
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(spread).collect()}
    # all lines of a block go, those of documents that are copied to many sites too
    assert out[3] == ("own 3\n" + "\n".join(f"more 3 {j}" for j in range(6)), 12, 5) and out[105] == ("", 3, 3) and out[205] == ("end 5", 4, 3) and out[305][2] == 0
    assert line_dedup(spread, counts=False).columns == spread.columns
    assert line_dedup(spread).exceptAll(line_dedup(spread, filter_lines=0)).count() == 0


CLASHING = ["gone", "id", "lines", "left", "__gone", "__id", "__found", "_found", "found", "N_Lines", "n_words", "n_hit", "contaminated", "n_removed", "items", "a.b", "back`tick", "h", "g", "wide", "hit", "row"]


def test_columns_of_any_name_pass_through(spark, sf):
    docs = docs_of(spark, [(k, f"w{k} " * 30 + "\nshared line", f"s{k}") for k in range(20)]).withColumns({c: F.lit(f"<{c}>") for c in CLASHING})
    want = {c: f"<{c}>" for c in CLASHING}
    own = lambda df, but=(): {k: v for k, v in df.first().asDict().items() if k in want and k.lower() not in but}
    assert own(line_dedup(docs), ("n_lines", "n_removed")) == {k: v for k, v in want.items() if k not in ("N_Lines", "n_removed")}
    assert own(line_dedup(docs, filter_lines=0), ("n_lines", "n_removed")) == {k: v for k, v in want.items() if k not in ("N_Lines", "n_removed")}
    replaced = ("n_words", "n_hit", "contaminated", "items", "spans", "longest", "clean_text")
    bench = spark.createDataFrame([(1, "w3 w3"), (2, "x y")], "item_id long, text string")
    assert own(decontaminate(docs, bench), replaced) == {k: v for k, v in want.items() if k not in replaced}
    assert without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and own(out) == want, name


def test_near_dedup_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            text = [rng.choice(vocabulary) if rng.random() < 0.012 else w for w in own]
            rows.append((k, (" ".join(text)).upper() if k % 2 else "  ".join(text), "a"))
            k += 1
    sets = {}
    for i, t, _ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: r for r in near_dedup(docs_of(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in sets}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())
    rows = near_dedup(odd).collect()
    assert len(rows) == len(ODD) and near_dedup(none).count() == 0
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, True)} and [(r.component_id, r.kept) for r in rows if r.doc_id == 5] == [(4, False)]
    assert all(r.n_shingles == 0 and r.kept for r in rows if r.doc_id in (1, 2, 3))


def test_near_dedup_of_many_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(74)]
    rows, expected = [], {}
    for k in range(0, 600, 2):
        tail = [f"w{rng.randrange(10**6)}" for _ in range(15)]
        other = tail[:4] + [f"w{rng.randrange(10**6)}" for _ in range(11)] if k % 8 == 0 else [f"w{rng.randrange(10**6)}" for _ in range(15)]
        rows += [(k, " ".join(passage + tail), "a"), (k + 1, " ".join(passage + other), "a")]
        expected |= {k: k, k + 1: k if k % 8 == 0 else k + 1}
    rng.shuffle(rows)
    docs = docs_of(spark, rows)
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == expected
    # regions that are split have all their pairs compared too
    monkeypatch.setattr("tidewind.llm.near_dedup.REGION", 64)
    monkeypatch.setattr("tidewind.llm.near_dedup.BLOCK", 32)
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == expected
    # and regions whose sets take too much room
    monkeypatch.setattr("tidewind.llm.near_dedup.REGION", 2048)
    monkeypatch.setattr("tidewind.llm.near_dedup.BLOCK_BYTES", 20_000)
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == expected


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 21)] + [(30 + k, 31 + k) for k in range(20)] + [(100, 100 + k) for k in range(1, 40)]
    table = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(table).collect()}
    assert got == {r.node: r.component for r in components(table, 0).collect()}
    assert got[3] == 1 and got[9] == 7 and got[50] == 30 and got[139] == 100 and 1 not in got


def test_substring_dedup_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(30):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(55, 70)]
        if i % 7 == 0:
            w += ["again"] * rng.randint(40, 70)
        rows.append((i, " \n".join(w) if i != 20 else " ".join(passage), "a"))
    rows.append((31, rows[9][1], "a"))
    first, expected = {}, {}
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t, _ in rows}
    for i in sorted(texts):
        for j in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][j : j + 50]), i)
    for i, w in texts.items():
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        expected[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(docs_of(spark, rows)).collect()}
    assert got == expected and any(n for _, n, _ in expected.values())
    # the same without a Bloom filter of the index
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(docs_of(spark, rows), bloom_bytes=0).collect()} == expected
    big = docs_of(spark, [(None, rows[9][1], "a"), (2**63 - 1, "short", "b")])
    assert {r.doc_id: r.n_removed for r in substring_dedup(big).collect()} == {None: 0, 2**63 - 1: 0}
    rows = substring_dedup(odd).collect()
    assert len(rows) == len(ODD) and substring_dedup(none).count() == 0 and all(r.n_removed == 0 for r in rows) and {r.text for r in rows if r.doc_id == 4} == {"same text"}


def test_decontamination_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "Same, text"), (None, "alone"), (2, None), (1, "same text"), (3, "")], "item_id long, text string")
    rows = decontaminate(odd, bench).collect()
    assert [r.n_hit for r in rows if r.doc_id == 4] == [2, 2] and all(r.contaminated and r["items"] == ["1"] and r.clean_text == "same text" for r in rows if r.doc_id in (4, 5) and r.text == "same text")
    assert all(r.n_words == 0 and not r.contaminated for r in rows if r.text is None) and len(rows) == len(ODD)
    few = decontaminate(odd, bench, block_words=1)  # an automaton for each item, more than one pass takes
    more = spark.createDataFrame([(k, f"w{k} x") for k in range(12)] + [(50, "same text"), (51, "text same"), (52, "long word")], "item_id long, text string")
    assert few.select("doc_id", "n_hit", "items").exceptAll(decontaminate(odd, bench).select("doc_id", "n_hit", "items")).count() == 0
    shown = ["doc_id", "text", "n_words", "n_hit", "items", "longest", "contaminated", "clean_text"]
    many = decontaminate(odd, more, block_words=1)
    assert many.count() == len(ODD) and many.select(shown).exceptAll(decontaminate(odd, more).select(shown)).count() == 0
    assert decontaminate(none, bench).count() == 0 and decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0


def test_pii_on_odd_rows(spark, odd, none):
    assert find_pii(odd).count() == len(ODD) and find_pii(none).count() == 0 and {r.doc_id for r in find_pii(odd).collect()} == {i for i, _, _ in ODD}


def test_packing_round_trip(spark, odd, none):
    packed = pack_documents(odd, capacity=64)
    rows = packed.collect()
    assert pack_documents(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    plain = docs_of(spark, [(k, f"some words of {k} " * (k + 1), "a") for k in range(20)]).select("doc_id", "text")
    ids = tokenized(plain, capacity=64, with_ids=True)
    full = sequences(ids, pack_documents(plain, capacity=64)).collect()
    assert sum(len(r.ids) for r in full) == sum(len(r.ids) for r in ids.collect()) and max(len(r.ids) for r in full) <= 4 * 64


def test_islands_are_tasks_that_trade_elites(spark, tmp_path):
    rng = random.Random(2)
    rows = [(0, k, rng.randint(256, 512)) for k in range(900)] + [(1, k, rng.randint(200, 500)) for k in range(900)]
    plain = {}
    for s in (0, 1):
        lengths = [n for t, _, n in rows if t == s]
        found = packing.best_fit_decreasing(lengths)
        plain[s] = len(found.bins), packing._numbers(found, len(lengths)).tolist()
    shards = spark.createDataFrame([(s, k, n, plain[s][1][k]) for s, k, n in rows], "shard long, at int, length long, bin int")
    got = packing.evolved(shards, 1024, str(tmp_path)).collect()
    for s in (0, 1):
        own = {r["at"]: r.bin for r in got if r.shard == s}
        fill = {}
        for k, b in own.items():
            fill[b] = fill.get(b, 0) + rows[900 * s + k][2]
        assert len(own) == 900 and max(fill.values()) <= 1024 and len(fill) < plain[s][0]
    # each epoch is written by a task for each island, and an island's best of one epoch is never worse than the elite that came to it
    states = [spark.read.parquet(f"{tmp_path}/epoch{k}").groupBy("shard", "island").agg(F.first(F.struct("n", "square")).alias("s")).collect() for k in range(packing.EPOCHS)]
    for before, after in zip(states[:-1], states[1:], strict=True):
        score = {(r.shard, r.island): tuple(r.s) for r in before}
        assert len(score) == 2 * packing.ISLANDS and all(tuple(r.s) <= score[r.shard, (r.island - 1) % packing.ISLANDS] for r in after)


def test_packing_of_many_equal_rows_and_small_shards(spark):
    rows = docs_of(spark, [(None, "the same words " * 40, "a")] * 300 + [(k, "w " * (k % 300), "a") for k in range(300)])
    pieces = tokenized(rows.select("doc_id", "text"))
    out = packing.pack(pieces, size=150).collect()
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(out) == 600 and max(fill.values()) <= 1024 and len(fill) <= 1.01 * sum(fill.values()) / 1024 + 4


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>", 5), (2, "http://a/2", "<p>x</p>", 5), (3, None, None, 5), (4, "u\r\nv", "", 5), (None, "n", "é\r\n\r\nz", 5), (2, "http://a/2", "<p>x</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, address int")
    write_archive(pages, str(tmp_path / "one"))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in read_records(spark, str(tmp_path / "one")).collect()}
    assert got == {(1, "revisit", 2, 8), (2, "response", None, 8), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "response", None, 7)}
    back = reconstruct(spark, str(tmp_path / "one")).collect()
    assert {(r.page_id, r.url) for r in back} == {(r.page_id, r.url) for r in read_records(spark, str(tmp_path / "one")).collect()} == {(r[0], r[1]) for r in rows}
    texts = spark.createDataFrame([("a>b", "u", "x"), ("ä 1", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    write_archive(texts, str(tmp_path / "text"))
    assert {(r.page_id, r.refers_to) for r in read_records(spark, str(tmp_path / "text")).collect()} == {("a>b", "ä 1"), ("ä 1", None), (None, None)}
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(r[2] or "" for r in rows) and all(bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n") for r in back)
    assert spark.read.parquet(str(tmp_path / "one" / "payloads")).count() == 3
    write_archive(pages, str(tmp_path / "two"), min_bytes=8)
    assert {(r.page_id, r.record_type) for r in read_records(spark, str(tmp_path / "two")).collect() if r.payload_bytes < 8} == {(3, "response"), (4, "response"), (None, "response")}
    export_files(spark, str(tmp_path / "one"), str(tmp_path / "warc"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    n, at = 0, 0
    while at < len(raw):  # each record's length says where it ends
        head = raw.index(b"\r\n\r\n", at) + 4
        at = head + int(re.search(rb"Content-Length: (\d+)", raw[at:head])[1]) + 4
        n += 1
    assert n == 6
    write_archive(pages.limit(0), str(tmp_path / "none"))
    assert read_records(spark, str(tmp_path / "none")).count() == 0


def test_damaged_payloads_stop_the_read(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "a"))
    good = spark.read.parquet(str(tmp_path / "a" / "payloads")).withColumn("payload", F.encode(F.lit("y"), "UTF-8")).toPandas()
    spark.createDataFrame(good, spark.read.parquet(str(tmp_path / "a" / "payloads")).schema).write.mode("overwrite").parquet(str(tmp_path / "a" / "payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        read_records(spark, str(tmp_path / "a")).collect()


def test_wrong_headers_stop_the_read(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "a"))
    records = spark.read.parquet(str(tmp_path / "a" / "records"))
    wrong = records.withColumn("header", F.regexp_replace("header", "sha1:..", "sha1:22")).toPandas()
    spark.createDataFrame(wrong, records.schema).write.mode("overwrite").parquet(str(tmp_path / "a" / "records"))
    with pytest.raises(Exception, match="wrong digest"):
        read_records(spark, str(tmp_path / "a")).collect()


def test_page_text(spark, sf, tmp_path):
    page = lambda k: f"<html><body><nav>Menu here</nav><div class=x><p>Say no to spam</p></div><article><p>Join us today</p><p>Story {k} tells of {k * 7}.</p></article></body></html>"
    rows = [(k, f"https://Host.org:80/{k}", page(k), 1) for k in range(8)] + [(90, None, None, 1), (91, "http://x/", "", 1), (92, "http://host.org/", page(3), 1), (None, "http://y", "<p>a</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got[3] == got[92] == "Story 3 tells of 21." and got[90] == got[91] == "" and got[None] == "a" and len(got) == len(rows)
    assert {r.page_id: r.text for r in extract(pages, broadcast_tokens=0).collect()} == got
    kinds = template(parsed(pages.where("page_id < 9"), str(tmp_path)))
    assert kinds.where("text").count() == 3 and extract(pages.limit(0)).count() == 0
    # on the test pages, against their article elements
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", "", re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        parts = [re.sub(r"\s+", " ", entities.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert texts[r.page_id] == "\n\n".join(x for x in parts if x)


def brute_template(pages):
    """The constant texts of a host's pages, straight from the definitions; pages: those that differ."""
    own = [{t.token: t for t in read(p).tokens} for p in pages]
    vector = {t: tuple(o[t].n if t in o else 0 for o in own) for t in set().union(*own)}
    pages_of = {t: sum(x > 0 for x in v) for t, v in vector.items()}
    some = {t: next(o[t] for o in own if t in o) for t in vector}
    classes = {}
    for t, v in vector.items():
        if pages_of[t] >= 4:
            classes.setdefault(v, set()).add(t)
    classes = {v: c for v, c in classes.items() if len(c) >= 2}
    of = {t: v for v, c in classes.items() for t in c}
    parents, good = {}, set()
    for v, c in classes.items():
        orders, around, inside = set(), set(), True
        for o in own:
            here = sorted((o[t] for t in c if t in o), key=lambda t: t.first)
            if here:
                orders.add(tuple(t.token for t in here))
                up = here[0].above
                while up in of and of[up] == v:
                    up = o[up].above
                around.add(of.get(up))
                low, high = here[0].first, max(t.last for t in here)
                inside &= not any(low < x < high for t in classes.get(of.get(up), ()) if t in o for x in (o[t].first, o[t].last))
        parents[v] = around
        if len(orders) == 1 and len(around) == 1 and inside:
            good.add(v)
    valid = {v for v in good if parents[v] == {None} or parents[v] <= good}
    return {t for t, v in of.items() if v in valid and some[t].text and pages_of[t] >= 0.5 * pages_of.get(some[t].above, 0)}


def test_template_against_brute_force(spark, tmp_path):
    rng = random.Random(6)

    def page(k, layout):
        notice = "<div class=hint><p>Read this first.</p><p>It matters.</p></div>"
        body = "".join(f"<p>Story {k} part {j} {rng.random()}</p>" for j in range(rng.randint(1, 4)))
        rare = "<p>Seen on some pages.</p>" if k % 3 == 0 else ""
        swapped = "<i>x</i><section><p>One way</p></section><section><p>or another</p></section>" if k % 2 else "<section><p>or another</p></section><section><p>One way</p></section>"
        extra = f"<ul>{''.join(f'<li>Item {j}</li>' for j in range(k % 3))}</ul>"
        return f"<html><body><div class=top>Welcome</div><article class=l{layout}>{notice if layout else ''}<h1>Head {k}</h1>{body}{rare}{swapped if k % 5 else ''}{extra}</article><div>Bye</div></body></html>"

    pages = {host: [page(k, k % 4 == 0) for k in range(n)] for host, n in (("a", 24), ("b", 7), ("c", 3))}
    table = spark.createDataFrame([(k, f"http://{h}/{k}", p) for h, own in pages.items() for k, p in enumerate([*own, own[0]])], "page_id long, url string, html string")
    got = {}
    for r in template(parsed(table, str(tmp_path))).where("constant").collect():
        got.setdefault(r.host, set()).add(r.token)
    assert got == {h: t for h, own in pages.items() if (t := brute_template(own))}
    texts = {(r.url, r.text) for r in extract(table).collect()}
    # the notice of a layout on a quarter of the pages is template, the passage that a third of the pages share is content
    assert not any("It matters" in t for u, t in texts if u.startswith("http://a/")) and sum("Seen on some" in t for u, t in texts if u.startswith("http://a/")) == 9
    assert extract(table).exceptAll(extract(table, broadcast_tokens=0)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) > 0.88 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.01 * n[0, 0]


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 1, 1), (1, 0, 0), (4, 0, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity(none, labels).count() == 0 and toxicity(odd, labels.limit(0)).where("score > 0.01").count() == 0
    assert without_toxic(odd, labels.limit(0)).columns == odd.columns and without_toxic(odd, labels.limit(0)).count() == len(ODD)


def brute_lines(rows):
    """Texts without the lines on ten sites."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if trim(line):
                sites.setdefault(trim(line), set()).add(r.source)
    gone = {line for line, at in sites.items() if len(at) >= 10}
    return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if trim(x) not in gone) for r in rows}


def brute_near(rows):
    """Identifiers that are the least of their components."""
    sets, root = {}, {}
    for r in rows:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if top(i) == i}


def brute_contaminated(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i in items:
        w = words(i.text)
        k = min(13, len(w))
        if k:
            windows.setdefault(k, set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    out = set()
    for r in rows:
        w = words(r.text)
        hit = {p for k, known in windows.items() for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in known for p in range(j, j + k)}
        if hit and 20 * len(hit) >= len(w):
            out.add(r.doc_id)
    return out


def test_pipeline_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), sf)
        assert out.columns == docs.columns
        return out.collect()

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect()}
    kept = after("toxicity", before)
    assert sorted(kept) == sorted(r for r in before if r.doc_id in clean)
    texts = brute_lines(kept)
    cut = after("line_dedup", kept)
    assert {r.doc_id: r.text for r in cut} == texts and len(cut) == len(kept) and any(texts[r.doc_id] != r.text for r in kept)
    assert all(r.n_chars == (len(r.text) if r.text != old.text else old.n_chars) for r, old in zip(sorted(cut), sorted(kept), strict=True))
    alone = brute_near(cut)
    apart = after("near_dedup", cut)
    assert sorted(apart) == sorted(r for r in cut if r.doc_id in alone) and len(apart) < len(cut)
    dirty = brute_contaminated(apart, spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    last = after("decontamination", apart)
    assert sorted(last) == sorted(r for r in apart if r.doc_id not in dirty) and dirty
    pieces = stages["packing"](spark, spark.createDataFrame(last, docs.schema), sf).collect()
    model, fill, lengths = Tokenizer.from_file(packing.default_vocabulary()), {}, {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in last} and max(fill.values()) <= 1024
    assert len(fill) <= packing.least_bins([r.length for r in pieces]) + 1
    # run() is the stages, one after the other
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_folders_are_shared_and_can_be_tidied(spark):
    from types import SimpleNamespace

    from tidewind.llm import common

    common.tidy(spark)
    one = common.written(spark.range(3).toDF("x"), "a")
    path = one.inputFiles()[0]
    assert one.count() == 3 and common.tidy(spark) == 1 and common.tidy(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT|No such file"):
        spark.read.schema("x long").parquet(path).collect()
    def unset(master):  # like a session, it lets nobody set the folder once it runs
        def refuse(name, value):
            assert name != "spark.checkpoint.dir"

        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default, set=refuse), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(unset(master))
    first, second = common.shared_dir(unset("local[2]")), common.shared_dir(unset("local[2]"))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    common._MADE.clear()
    assert common.fresh(["A", "_a"], "a", "b") == ["__a", "b"] and common.quoted("x`y") == "`x``y`"
