"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import (
    dart_minhash, exact_dedup, language_id, line_crf, line_join, mixing, packing, pii, warc_fixity, window_dedup,
)
from plumbline.llm.components import components

# extra columns carry names that the operators use for their results
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string"


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, *(more + (None,) * (2 - len(more))), None, "x", "y", "z") for i, t, *m in rows for more in [tuple(m)]], DOCS
    ).repartition(3)


def passage(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = passage(rng, 40)
    rows = [(i, "\n".join(passage(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, passage(rng, 20) + " " + shared + " " + passage(rng, 15), "de", "s0") for i in range(8)]
    rows += [(200 + i, rows[i][1], "en", None) for i in range(6)]  # exact copies
    for i in range(6):  # near copies
        words = rows[40 + i][1].split(" ")
        words[3] = "changed"
        rows.append((300 + i, " ".join(words), None, "s1"))
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "   \n\t ", "en", "s0"), (403, "tiny", "en", "s1"),
             (None, "no id here at all", "en", "s1"), (404, "ABC déf ÉÀ", "fr", "s2"), (405, "abc déf ÉÀ", "fr", "s2"),
             (406, passage(rng, 4000), "en", "s2"), rows[2], rows[2], (405, "another text of a repeated id", "fr", "s2")]
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_groups(spark, corpus):
    for support in (0.001, 0.04):
        got = exact_dedup.exact_groups(docs_of(spark, corpus), support=support).collect()
        groups = {}
        for i, t, *_ in corpus:
            groups.setdefault(lowered(t), []).append(i)
        assert len(got) == len(corpus)
        sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = sha[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in got) == len(groups)
        left = exact_dedup.drop_exact_copies(docs_of(spark, corpus), support=support)
        assert left.columns == docs_of(spark, corpus).columns
        assert Counter(lowered(r["text"]) for r in left.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é {i}\r\n\r\nWARC/1.1\r\n" + "x" * (i * 37 % 900)) for i in range(900)]
    rows += [(5000, None, None), (None, "u", "no id"), (7, "again", "repeated id"), (7, "again", "repeated id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first, second = warc_fixity.replicated(pages, F.col("page_id").isin(3, 450, 899))
    got = warc_fixity.audited(spark, first, second).collect()
    assert len(got) == len(rows)
    assert {r["page_id"] for r in got if r["state"] == "changed"} == {3, 450, 899}
    assert {r["state"] for r in got} == {"changed", "intact"}
    a = warc_fixity.read_archives(spark, first)
    lost = a.filter("coalesce(page_id, -1) <> 10")
    assert [tuple(r) for r in warc_fixity.audit(a, lost).select("state").collect()] == [("missing",)]
    assert warc_fixity.audit(a, a).count() == 0


def test_replicas_come_of_one_pass_over_the_pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}") for i in range(1100)] + [(None, "u", "no id"), (1200, "v", None), (1201, "w", "")]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(html):
        seen.add(1)
        return html

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("html", counted("html"))
    paths = warc_fixity.replicated(pages, F.coalesce(F.col("page_id") % 97 == 3, F.lit(True)))
    assert seen.value == len(rows)
    got = warc_fixity.audited(spark, *paths).collect()
    assert len(got) == len(rows)
    assert {r["page_id"] for r in got if r["state"] == "changed"} == {None, *(i for i in range(1100) if i % 97 == 3)}
    assert {r["state"] for r in got} == {"changed", "intact"}


@pytest.mark.parametrize("damage", ["drop", "shorten", "length", "id", "flip", "trailer", "cut"])
def test_audit_of_damaged_files(spark, tmp_path, damage):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", passage(rng, 40)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = f"{tmp_path}/a", f"{tmp_path}/b"
    for path in paths:
        warc_fixity.write_archives(pages, path, 30)
    file = next((tmp_path / "b" / "archive=0").glob("*.gz"))
    (tmp_path / "b" / "archive=0" / f".{file.name}.crc").unlink(missing_ok=True)
    packed = bytearray(file.read_bytes())
    records = [r + b"\r\n\r\n" for r in re.split(rb"\r\n\r\n(?=WARC/1.1|$)", zlib.decompress(packed, 31))][:30]
    if damage in ("flip", "trailer", "cut"):
        if damage == "cut":
            del packed[len(packed) // 2 :]
        else:
            packed[len(packed) // 2 if damage == "flip" else -6] ^= 255
    else:
        records[7] = {
            "drop": b"", "shorten": records[7].replace(b"http://x/7", b"http:/7"),
            "length": records[7].replace(b"Content-Length: ", b"Content-Length: x"),
            "id": records[7].replace(b"<urn:page:7", b"<urn:page:q"),
        }[damage]
        packer = zlib.compressobj(wbits=31)
        packed = packer.compress(b"".join(records)) + packer.flush()
    file.write_bytes(packed)
    both = [warc_fixity.read_archives(spark, path) for path in paths]
    offsets = {r["offset"]: r["page_id"] for r in both[0].collect()}
    found = [(offsets.get(r["offset"]), r["state"]) for r in warc_fixity.audit(*both, range_bytes=4096).collect()]
    if damage == "trailer":
        assert found == [(None, "extra")]
    elif damage in ("flip", "cut"):
        assert found and all(i is None or i > 5 for i, _ in found)
    else:
        assert found == [(7, {"drop": "missing"}.get(damage, "changed"))]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_line_join(spark, corpus):
    rng = random.Random(9)
    rows = list(corpus)
    for i in range(12):
        line = list(passage(rng, 8))
        for k in range(3):
            changed = list(line)
            for _ in range(k):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            rows.append((1000 + 10 * i + k, "".join(changed) + "\n" + passage(rng, 3), "en", "s0"))
    base = passage(rng, 8)
    for i in range(90):  # one crowded family, with more edits than count in most of its pairs
        changed = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é", "q"])
        rows.append((2000 + i, "".join(changed), "en", "s0"))
    occurrences, lines = [], []
    for n, (i, t, *_) in enumerate(rows):
        for at, line in enumerate((t or "").split("\n")):
            if line.encode().split():
                occurrences.append((n, i, at, line))
    lines = sorted({o[3] for o in occurrences})
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            limit = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= limit and levenshtein(a, b) <= limit:
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    got = line_join.duplicate_lines(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["n_lines"] for r in got) == len(occurrences)
    assert sum(r["n_links"] for r in got) == sum(links[o[3]] for o in occurrences)
    assert sum(r["n_removed"] for r in got) == len(occurrences) - len({find(x) for x in lines})
    cut = spark.createDataFrame([("a\nb\n\nc", [1, 2])], "t string, r array<int>")
    assert cut.select(line_join.without_lines(F.col("t"), F.col("r"))).first()[0] == "a\nc"
    assert line_join.duplicate_lines(empty(spark)).count() == 0


def test_line_join_keeps_texts_of_lines_that_meet_only(spark, monkeypatch):
    rng = random.Random(3)
    lines = [passage(rng, 12) for _ in range(300)]
    rows = [(i, line) for i, line in enumerate(lines)]
    rows += [(500, lines[0][:-1] + "?"), (501, lines[1] + "?"), (502, lines[1])]
    kept, landed = [], line_join.landed

    def watched(df, label):
        table = landed(df, label)
        if {"line", "text", "p"} & set(table.columns):
            kept.append(table.count())
        return table

    monkeypatch.setattr(line_join, "landed", watched)
    got = {r["doc_id"]: (r["n_links"], r["n_removed"]) for r in line_join.duplicate_lines(docs_of(spark, rows)).collect()}
    assert {i: x for i, x in got.items() if x != (0, 0)} == {0: (1, 0), 500: (1, 1), 1: (1, 0), 501: (1, 1), 502: (1, 1)}
    assert kept and max(kept) < 20


def test_line_join_finds_all_among_marked_hashes(spark):
    ids = spark.createDataFrame([(x,) for x in (-(1 << 63), (1 << 63) - 1, -1, 0, 1, 7, 8, 32767, 32768, 123456789)], "id long")
    rows = spark.createDataFrame([(r["id"], "x") for r in ids.collect()] + [(1000 + x, "y") for x in range(2000)], "h long, of string")
    got = [r["of"] for r in line_join._among(rows, "h", ids).collect()]
    assert got.count("x") == 10 and got.count("y") < 20
    assert line_join._among(rows, "h", ids.limit(0)).count() == 0


def test_line_quality_counts_and_verdicts(spark, corpus):
    clean = "\n".join(passage(random.Random(i), 12).capitalize() + "." for i in range(10))
    junk = "\n".join(f"{w}*** {w[::-1]}### %%% &&&" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma"))
    rows = [*corpus, (900, clean), (901, junk), (902, "one two three four five " * 30)]
    docs = docs_of(spark, rows)
    field = line_crf.fit_lines(docs)
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in line_crf.line_quality(docs, field).collect()}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i, len(words), sum(map(len, words))]
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    by_id = {r["doc_id"]: r for r in got.values()}
    assert by_id[900]["kept"] and not by_id[901]["kept"] and by_id[902]["base_failed"]
    assert line_crf.line_quality(empty(spark), field).count() == 0
    assert line_crf.fit_lines(empty(spark)).decode(np.ones((3, line_crf.FEATURES))).tolist() == [0, 0, 0]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        field = line_crf.Field(rng.normal(size=(line_crf.FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, line_crf.FEATURES))

        def score(labels, x=x, field=field):
            s = (x @ field.emission)[np.arange(len(labels)), labels].sum()
            return s + sum(field.transition[a, b] for a, b in zip(labels, labels[1:]))

        best = max(([(m >> i) & 1 for i in range(n)] for m in range(1 << n)), key=score)
        assert field.decode(x).tolist() == best


@pytest.mark.parametrize("words", [["a"] * 9, list("abcabcabc"), [str(i % 7000) for i in range(9000)], list("abcdeabcd")])
def test_repeated_words(words):
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    assert line_crf.repeated_words([w.encode() for w in words]) == len(covered)


def test_mixing(spark, corpus):
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": 250 / 3, None: 500 / 3}
    assert mixing.targets({}) == {}
    # the pattern in both sources fills both, and nothing is repeated
    flow = mixing.route({"x": 100, "xy": 50}, {"x": ("x",), "xy": ("x", "y")}, {"x": 120, "y": 30})
    assert flow == {"x": 100, "xy": 50}
    rows = [(i, passage(random.Random(i), 5 + i % 40), "en", f"s{i % 4}") for i in range(800)] + corpus
    docs = docs_of(spark, rows)
    sized = mixing.sized(mixing.marked(docs, F.array("source")))
    plan = mixing.plan_mixture(sized)
    taken = mixing.times_taken(sized, plan)
    got = taken.groupBy(F.element_at("__pattern", 1).alias("s")).agg(F.sum(F.col("__times") * F.col("size")).alias("n")).collect()
    for r in got:
        assert abs(r["n"] - plan.quotas[r["s"]]) <= 0.02 * plan.quotas[r["s"]] + 5
    assert taken.filter("__times > 2 or __times < 0").count() == 0
    mixed = mixing.mix_documents(docs, F.array("source"))
    assert mixed.columns == docs.columns
    assert mixed.count() == taken.agg(F.sum("__times")).first()[0]
    assert mixing.mix_documents(empty(spark), F.array("source")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_find(text):
    spans = [(0, *m.span()) for m in EMAIL.finditer(text)]
    spans += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii._luhn(d):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+ 0129()é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.find(text) == plain_find(text)


def test_disguised_spans(spark):
    cases = {
        "write to jane.doe (at) example (dot) com now": "jane.doe (at) example (dot) com",
        "write to jane at example dot org please": "jane at example dot org",
        "mail jаne@exаmple.com today": "jаne@exаmple.com",
        "ip 10 dot 20 dot 30 dot 40 end": "10 dot 20 dot 30 dot 40",
        "call plus four nine one five one two three four five six seven eight": "plus four nine one five one two three four five six seven eight",
        "full ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ width": "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ",
        "zero​width j​oe@ex.com": "j​oe@ex.com",
    }
    for text, found in cases.items():
        spans = pii.disguised(text, pii.find(text))
        assert [text[s:e] for _, s, e in spans][:1] == [found] or found in [text[s:e] for _, s, e in pii.find(text) + spans], text
    for text in ("meet me at noon and dot the i", "one two three", "at the end", "a@b", "die drei at dot", ""):
        assert pii.disguised(text, pii.find(text)) == []
    rows = [(1, "a@b.co and +49 151 2345678"), (None, None), (2, ""), (2, "x" * 200_000), (3, "1" * 50_000)]
    got = pii.personal_data(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r["doc_id"] == 1)
    assert (r["spans"], r["n_email"], r["n_phone"]) == ("email:0:6,phone:11:26", 1, 1)
    assert pii.personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("text, found", [
    ("call plus 49 151 2345678", "plus 49 151 2345678"), ("jane { at } example.com", "jane { at } example.com"),
    ("to jane < at > example.com", "jane < at > example.com"), ("jane{@}example.com", "jane{@}example.com"),
    ("jane (  at) example.com", "jane (  at) example.com"), ("jane (\nat) example.com", "jane (\nat) example.com"),
    ("jane\n@example.com", "jane\n@example.com"), ("jane@\texample.com", "jane@\texample.com"),
    ("is 10{.}20{.}30{.}40", "10{.}20{.}30{.}40"), ("10 ( . ) 20 ( . ) 30 ( . ) 40", "10 ( . ) 20 ( . ) 30 ( . ) 40"),
])
def test_disguises_without_other_signs(text, found):
    assert found in [text[s:e] for _, s, e in pii.disguised(text, pii.find(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["jane", "ex.com", "at", "@", ".", "dot", "plus", "49", "151", "2345678", "(", ")", "{", "}", "<", ">", "[", "]", " ", "\n", "f\u0131ve",
     "\u017fIX", "n\u0130ne", "one"]), max_size=14).map("".join))
def test_every_rewriting_is_searched(text):
    # nothing that the grammar rewrites may be kept from the detectors
    plain, begins, sources = pii.normalise(text)
    shown = {
        k for k, a, b in pii.find(plain)
        if any(r == 1 and begins[i] < b and a < (begins + [len(plain)])[i + 1] for i, (_, _, r) in enumerate(sources))}
    assert shown <= {k for k, _, _ in pii.disguised(text, [])}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def test_near_classes(spark, corpus):
    sets = [shingles(t) for _, t, *_ in corpus]
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            total = sum((sets[i] | sets[j]).values())
            if total and sum((sets[i] & sets[j]).values()) >= 0.8 * total:
                parent[find(i)] = find(j)
    got = dart_minhash.near_duplicates(docs_of(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert sum(r["kept"] for r in got) == len({find(i) for i in range(len(corpus))})
    sizes = Counter(find(i) for i in range(len(corpus)))
    assert sorted(r["class_size"] for r in got) == sorted(sizes[find(i)] for i in range(len(corpus)))
    left = dart_minhash.drop_near_duplicates(docs_of(spark, corpus))
    assert left.columns == docs_of(spark, corpus).columns and left.count() == len(sizes)
    assert dart_minhash.near_duplicates(empty(spark)).count() == 0


def test_near_classes_of_a_crowded_family(spark):
    # all documents are much alike, so that their buckets are large, but only the two of a pair are similar, and mostly
    # neither is a leader
    rng = random.Random(11)
    base, rows = passage(rng, 100).split(" "), []
    for i in range(100):
        member = list(base)
        for at in rng.sample(range(5, 95), 2):
            member[at] = f"m{i}x{at}"
        twin = list(member)
        for at in rng.sample(range(5, 95), 2):
            twin[at] = f"t{i}x{at}"
        rows += [(2 * i, " ".join(member)), (2 * i + 1, " ".join(twin))]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    got = dart_minhash.near_duplicates(docs_of(spark, rows)).collect()
    largest = {}
    for i, _ in rows:
        largest.setdefault(find(i), []).append(i)
    wanted = {i: sorted(members) for members in largest.values() for i in members}
    found = {}
    for r in got:
        found.setdefault(r["class_id"], []).append(r["doc_id"])
    assert {i: sorted(members) for members in found.values() for i in members} == wanted


def test_close_pairs_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 7)
    rng = np.random.default_rng(4)
    pool = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = [sorted({int(v) for v in rng.choice(pool, int(rng.integers(20, 50)), replace=False)}) for _ in range(90)]
    sets += [s[:-1] for s in sets[:30]]
    labels = [i % 7 for i in range(len(sets))]
    placed = spark.createDataFrame(
        [(1, k, i, labels[i]) for k, members in ((3, range(80)), (4, range(60, 120)), (5, range(10, 120))) for i in members],
        "band int, key long, node long, label long")
    nodes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, weight long")
    strips = spark.createDataFrame(list(enumerate(sets)), "node long, strips array<long>")
    got = {(r["a"], r["b"]) for r in dart_minhash.close_pairs(placed, nodes, strips, 0.8).collect()}
    wanted = {
        (a, b) for members in (range(80), range(60, 120), range(10, 120)) for a in members for b in members
        if a < b and labels[a] != labels[b]
        and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert got == wanted and len(wanted) > 10


def test_close_pairs_as_a_forest_connect_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 40)
    rng = np.random.default_rng(5)
    base = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 60)]
    # three families; within one, all are similar
    sets = [sorted({*base[20 * (i % 3) : 20 * (i % 3) + 20], 1000 + i}) for i in range(120)]
    labels = [i if i % 4 else i % 3 for i in range(120)]
    placed = spark.createDataFrame([(1, 3, i, labels[i]) for i in range(120)], "band int, key long, node long, label long")
    nodes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, weight long")
    strips = spark.createDataFrame(list(enumerate(sets)), "node long, strips array<long>")
    every = dart_minhash.close_pairs(placed, nodes, strips, 0.8).collect()
    got = dart_minhash.close_pairs(placed, nodes, strips, 0.8, forest=True).collect()
    assert {(r["a"], r["b"]) for r in got} <= {(r["a"], r["b"]) for r in every}
    assert len(got) < 6 * 120 < len(every) / 2  # six cells at the most

    def classes(pairs):
        place = {label: label for label in labels}
        while True:
            before = dict(place)
            for a, b in pairs:
                x, y = place[labels[a]], place[labels[b]]
                place = {k: min(x, y) if v in (x, y) else v for k, v in place.items()}
            if place == before:
                return place

    assert classes([(r["a"], r["b"]) for r in got]) == classes([(r["a"], r["b"]) for r in every])


def test_dart_ranks_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    other = np.concatenate((base[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    ranks = dart_minhash.dart_ranks(np.concatenate((base, other, base[:2])), np.array([400, 400, 2]), 2000)
    assert np.isfinite(ranks).all()
    assert abs((ranks[0] == ranks[1]).mean() - 300 / 500) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001)]
    rng.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    labels = {r["node"]: r["label"] for r in rows}
    assert len(rows) == len(labels) == 201 + 50 + 2
    assert len(set(labels.values())) == 3 and labels[0] == labels[200] != labels[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [(950, "a  b \n c  "), (951, "<|endoftext|> x  y"), (953, "a <|endoftext|>  b<|endoftext|><|endoftext|>c"),
           (954, "<|endoftext|>"), (955, " <|endoftext |> <|endoftext|> \n"), (952, "don't　we 12\t\t")]
    rows = [*corpus, *odd]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs_of(spark, rows), group=40).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        n = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - 1024 * k for k in range(n - 1, -1, -1))]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.array([r["length"] for r in got]))
    assert bound <= len(sequences) <= bound + 1
    assert packing.pack(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60))
def test_bound_and_best_fit(sizes):
    sizes = np.array(sizes, np.int64)
    place, offset, fill = packing.best_fit(sizes)
    assert packing.lower_bound(sizes) <= len(fill)
    assert (fill <= 1024).all() and fill.sum() == sizes.sum()
    assert sorted(zip(place, offset)) == sorted(set(zip(place, offset)))


def test_language_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(1 << 40, None), ((1 << 40) + 1, ""), ((1 << 40) + 2, "12 34 !"), (None, "the and of")], "doc_id long, text string")
    model = language_id.fit_languages(docs)
    got = language_id.identify(docs.select("doc_id", "text").unionByName(odd), model)
    checked = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert checked > 0.95
    strange = {r["doc_id"]: r for r in got.filter(f"doc_id >= {1 << 40} or doc_id is null").collect()}
    assert all(strange[(1 << 40) + k]["lang_pred"] == "und" and strange[(1 << 40) + k]["rejected"] for k in range(3))
    assert strange[None]["lang_pred"] == "en" and strange[None]["held_out"] is False
    assert language_id.accepted(docs, model).columns == docs.columns
    none = language_id.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def without_repeated(rows):
    """doc_id, n_words, n_removed, kept_sha256 of every row, by brute force."""
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), rank(i))
    expected = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < rank(i):
                keep[k : k + 13] = [False] * 13
        left = [x for x, y in zip(w, keep) if y]
        expected[i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()] += 1
    return expected


@pytest.mark.parametrize("bits", [None, 6])  # few cells: every window is estimated repeated
def test_window_dedup(spark, corpus, bits):
    got = window_dedup.remove_repeated(docs_of(spark, corpus), bits=bits).drop("kept_text").collect()
    assert Counter(map(tuple, got)) == without_repeated(corpus)
    assert sum(r["n_removed"] for r in got) > 0
    assert window_dedup.remove_repeated(empty(spark)).count() == 0


@pytest.mark.parametrize("compared", [1, 50, 1 << 20])
def test_windows_compared_within_tasks(monkeypatch, compared):
    """A passage of very many documents, also many times in one document and in rows of one id, leaves a task about
    once for each part that it compares."""
    rng = random.Random(9)
    shared = passage(rng, 13)
    rows = [(i, f"{passage(rng, 5)} {shared} {passage(rng, 5)}") for i in range(300, 0, -1)]
    rows += [(301, " ".join([shared] * 30)), (302, "la " * 200), (303, "la lu " * 100), (7, shared), (None, shared), (None, shared + " x")]
    monkeypatch.setattr(window_dedup, "COMPARED", compared)

    class Sketch:
        value = np.full((window_dedup.DEPTH, 8), 255, np.uint8)

    monkeypatch.setattr("plumbline.llm.common.CHUNK_BYTES", 2000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([(1 << 63) - 1 if i is None else i for i, _ in rows]), pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t in rows])],
        names=["rank", "print", "text"])
    asked = [r for part in window_dedup._questions(Sketch, 6, 13, 5)(iter([batch])) for r in part.to_pylist()]
    low = {}
    for r in asked:
        low[r["a"], r["b"]] = min(r["rank"], low.get((r["a"], r["b"]), 1 << 63))
    spots = {}
    for r in asked:
        if r["b"] is None or r["rank"] > low[r["a"], r["b"]]:
            spots.setdefault(r["print"], []).append(r["spots"])
    rest = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows]), pa.array([spots.get(k) for k in range(len(rows))], pa.list_(pa.binary()))],
        names=["doc_id", "text", "spots"])
    got = [tuple(r.values())[:4] for part in window_dedup._remove(13)(iter([rest])) for r in part.to_pylist()]
    assert Counter(got) == without_repeated(rows)
    if compared == 1 << 20:
        key = max(low, key=lambda k: sum(r["b"] is not None and (r["a"], r["b"]) == k for r in asked))
        assert sum((r["a"], r["b"]) == key for r in asked) <= 2  # of the rows of least rank only


def test_columns_with_names_of_helpers(spark, corpus):
    """Stages of the pipeline give extra columns back as they are, whatever their names."""
    names = ["__n", "__key", "__digest", "__winner", "__pattern", "__k", "__place", "__row", "__times", "__copy", "__base",
             "__cut", "__fills", "doc", "digest", "id", "n", "key", "best", "winner", "kept_id", "members", "rank", "a b"]
    plain = docs_of(spark, corpus).select("doc_id", "text", "lang", "source")
    extra = plain.select("*", *(F.concat_ws("|", F.lit(name), F.col("doc_id")).alias(name) for name in names)).cache()

    stages = [exact_dedup.drop_exact_copies, dart_minhash.drop_near_duplicates,
              lambda docs: mixing.mix_documents(docs, F.array("source"))]
    for stage in stages:
        got = stage(extra)
        assert got.columns == extra.columns
        rows = got.collect()
        assert rows and all(r[name] == f"{name}|{r['doc_id']}".replace("|None", "") for r in rows for name in names)
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stage(plain.cache()).collect())
    extra.unpersist()


def test_languages_are_the_same_whatever_the_pieces(monkeypatch):
    texts = ["the house and the street", "", "das Haus und die Straße " * 40, "x", "la maison et la rue"]
    model = language_id.fit(texts * 4, ["en", "en", "de", "en", "fr"] * 4, language_id.Settings(steps=20, epochs=1))
    flat, offsets = language_id.text_bytes(pa.array(texts))
    whole = language_id.logits_of(flat, offsets, model)
    ids, owners = language_id.gram_ids(flat, offsets, model.settings)
    for i in range(len(texts)):
        mine = model.table[ids[owners == i]]
        assert whole[i] == pytest.approx((mine.mean(axis=0) if len(mine) else 0) + model.bias)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert language_id.logits_of(flat, offsets, model) == pytest.approx(whole)
        assert language_id.logits_of(flat, offsets[2:], model) == pytest.approx(whole[2:])


def test_unlearned_languages_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")  # some hundred texts a language
    rows = docs.filter("lang is not null").withColumn("held", language_id.is_held_out(F.col("doc_id"))).orderBy("doc_id")
    rows = rows.select("text", "lang", "held").collect()
    odd = ["Это простое предложение о погоде и о реке.", "asdkjh qwlekj zxmcnb poqiwe alskdj mznxcb"]

    def rejected(model, texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        return next(language_id.predictor(model)(iter([batch]))).to_pandas()

    for out in (None, *sorted({r["lang"] for r in rows})):
        learned = [r for r in rows if r["lang"] != out]
        train = [r for r in learned if not r["held"]]
        model = language_id.fit([r["text"] for r in train], [r["lang"] for r in train])
        assert 0.1 < model.temperature < 10
        assert rejected(model, [r["text"] for r in learned if r["held"]])["rejected"].mean() < 0.01
        if out is None:
            assert rejected(model, odd)["rejected"].all()
        else:
            assert rejected(model, [r["text"] for r in rows if r["lang"] == out])["rejected"].mean() >= 0.9
