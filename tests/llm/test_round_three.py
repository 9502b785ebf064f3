"""Suffix-sorted removal, filter audits and vector codes against brute force and on odd rows."""

import hashlib
import itertools
import json
import os
import re
import time

import numpy as np
import pytest

from paneltide.llm import chat_format, filter_audit, lang_id, queries, secret_scan, suffix_dedup, vector_codes

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key binary, string long, part string, bytes binary"


def docs(spark, texts, ids=None, langs=None):
    rows = [((i if ids is None else ids[i]), t, None if langs is None else langs[i], "s", 1, b"k", 5, "p", b"b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ removal of repeated strings


def removed_by_force(texts, length=200):
    """(bytes removed, spans, digest of the rest) of each text, from all strings of the length."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, text in enumerate(raw):
        for s in range(len(text) - length + 1):
            seen.setdefault(text[s : s + length], []).append((d, s))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d][s : s + length] = True
    out = []
    for text, flags in zip(raw, gone):
        left = bytes(b for b, g in zip(text, flags) if not g)
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out.append((int(flags.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def got(rows):
    return {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.fixture(scope="module")
def overlapping():
    """Passages that are cut, joined and nested in one another, of lengths around 200 bytes."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij klmno é漢"))
    fresh = lambda n: "".join(rng.choice(letters, n))
    base = [fresh(n) for n in (150, 199, 200, 201, 260, 900, 2500)]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            p = base[int(rng.integers(len(base)))]
            a = int(rng.integers(0, len(p) // 3))
            parts += [p[a : len(p) - int(rng.integers(0, len(p) // 3))], fresh(int(rng.integers(0, 40)))]
        texts.append("".join(parts))
    return [*texts, "x" * 199, "x" * 200, "y" * 201, "ab" * 700, "ab" * 120, "", None, "z" * 5000, base[5], base[5], base[5][:230] + base[6][100:340]]


def test_removal_by_force(spark, overlapping):
    rows = suffix_dedup.dedup(docs(spark, overlapping)).collect()
    assert got(rows) == dict(enumerate(removed_by_force(overlapping)))
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(overlapping)}


def test_removal_does_not_depend_on_cuts(spark, overlapping):
    """Chunks and a filter that is full only move work."""
    rows = suffix_dedup.kept_texts(docs(spark, overlapping), chunk=300, filter_bits=1 << 15).collect()
    assert got(rows) == dict(enumerate(removed_by_force(overlapping)))
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)


def test_removal_of_odd_rows(spark):
    long_one = "word " * 400
    frame = docs(spark, [long_one, long_one, None, "", "short", long_one], ids=[1, 1, 2, 3, 4, None])
    rows = suffix_dedup.kept_texts(frame).collect()
    assert sorted((r.n_removed, bytes(r.kept)) for r in rows) == [(0, b""), (0, b""), (0, b"short"), *[(2000, b"")] * 3]
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0
    assert suffix_dedup.dedup(docs(spark, ["a", None])).count() == 2


def suffix_ranks(strings):
    every = {(i, k): tuple(s[k:]) for i, s in enumerate(strings) for k in range(len(s))}
    return {p: sum(t < s for t in every.values()) for p, s in every.items()}


@pytest.mark.parametrize("letters", [1, 2, 50])
def test_suffixes_are_ranked_as_by_comparison(spark, letters):
    rng = np.random.default_rng(letters)
    strings = [rng.integers(1, letters + 1, n).tolist() for n in (1, 2, 3, 4, 5, 7, 26, 27, 28, 40)]
    frame = spark.createDataFrame(list(enumerate(strings)), "string long, symbols array<long>")
    made = {r.string: r.numbers for r in suffix_dedup.ranks(frame, 200).collect()}
    assert {(i, k): made[i][k] for i, s in enumerate(strings) for k in range(len(s))} == suffix_ranks(strings)


def test_every_string_of_the_length_holds_an_anchor():
    rng = np.random.default_rng(0)
    raw = np.frombuffer(bytes(rng.integers(97, 100, 4000).tolist()) + b"q" * 600, np.uint8)
    low, at, _ = suffix_dedup.anchors(raw, np.full(len(raw), len(raw)))
    starts = np.flatnonzero(low)
    assert len(starts) == len(raw) - suffix_dedup.LENGTH + 1
    nearest = at[np.searchsorted(at, starts)]
    assert (nearest - starts < suffix_dedup.WINDOW).all()


# ------------------------------------------------------------------ filter audits


def audit_by_force(rows, labels):
    """Every order is walked document by document. rows: (doc_id, text, lang)."""
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)
        marks = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        good, toxic = (any(q == 1 for j, *x in labels if j is not None and j == i for q in [x[k]]) for k in (0, 1))
        fails.append((lang or "", marks, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            here = mine
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [f for f in here if f[1][k]]
                here = [f for f in here if not f[1][k]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(here), len(gone), sum(f[1][k] for f in mine) - len(gone), sum(f[1] == [x == k for x in range(5)] for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), letter,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = total[out[key][-1]]
    return out


ODD = ["", None, "a b c", "A B C $ D", "w " * 300, "w " * 300, "\x0b x\x1cy\x0c\r\n ", " ".join(f"n{i}" for i in range(150)), "ÄÖ É 漢字 # " * 40, "XX" * 90]


def test_audit_by_force(spark):
    ids = [3, 4, 5, 6, 7, 8, None, 10, 10, 12, 12, 2]
    texts = [*ODD, "XX" * 90, ""]
    langs = ["en", None, "en", "", "de", "en", "de", "en", None, "en", "de", "en"]
    rows = list(zip(ids, texts, langs))
    labels = [(3, 1, 0), (3, 0, None), (5, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (12, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = filter_audit.audit(docs(spark, texts, ids, langs), frame).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in made} == audit_by_force(rows, labels)
    assert filter_audit.audit(docs(spark, []), frame).count() == 0
    assert filter_audit.audit(docs(spark, ["a"]), frame.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_shapley_values_are_means_over_orders():
    rng = np.random.default_rng(3)
    counts = {m: int(n) for m, n in enumerate(rng.integers(0, 50, 32))}
    v = filter_audit.removals(counts)
    for i, share in enumerate(filter_audit.shapley(v)):
        steps = []
        for order in itertools.permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            steps.append(v[before | 1 << i] - v[before])
        assert share * 120 == sum(steps)


# ------------------------------------------------------------------ vector codes


def codes_by_force(vectors, rounds=4):
    """vectors: (vec_id, components, label), ids unique. Whole numbers of Python throughout."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 1024)) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in column[:256]] for column in parts]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for x in parts[p]:
                groups.setdefault(nearest(x, books[p]), []).append(x)
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = {}
    for n, (i, _, label) in enumerate(kept):
        entries = [nearest(parts[p][n], books[p]) for p in range(4)]
        out[i] = ("".join(f"{e:02x}" for e in entries), sum(far(parts[p][n], books[p][e]) for p, e in enumerate(entries)), label)
    return out, digest


VECTORS = "vec_id long, embedding array<float>, label int, part array<double>, position int, code string"


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v, label, [1.0], 3, "x") for i, v, label in vectors], VECTORS)


@pytest.mark.parametrize("scale", [0.01, 1.0, 3e30])
def test_codes_by_force(spark, scale):
    rng = np.random.default_rng(8)
    vectors = [(int(i), (rng.normal(0, scale, 8) * (1 + i % 3)).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(290)]
    vectors += [(1000, vectors[0][1], 1), (1001, None, 1), (1002, [None] * 8, 1), (1003, [float("nan")] * 8, 2), (1004, [float("inf")] * 8, 2)]
    want, digest = codes_by_force(vectors)
    made = {r.vec_id: r for r in vector_codes.compress(frame_of(spark, vectors)).collect()}
    assert made.keys() == want.keys()
    fits = lambda x: x if x < 1 << 63 else None
    assert {i: (r.code, r.error) for i, r in made.items()} == {i: (c, fits(e)) for i, (c, e, _) in want.items()}
    assert {r.codebooks_sha256 for r in made.values()} == {digest}
    if scale < 1e3:
        sums = {}
        for _, error, label in want.values():
            sums[label] = sums.get(label, 0) + error
        assert {i: r.label_error for i, r in made.items()} == {i: sums[label] for i, (_, _, label) in want.items()}


def test_codes_of_odd_rows(spark):
    rows = [(5, [1.0] * 8, None), (5, [1.0] * 8, None), (None, [2.0] * 8, 1), (6, [1.0, 2.0], 1), (7, [], 1), (8, [3.0] * 11, 2)]
    made = sorted(((r.vec_id, r.code, r.error) for r in vector_codes.compress(frame_of(spark, rows)).collect()), key=str)
    assert made == sorted([(5, "00000000", 0), (5, "00000000", 0), (None, "03030303", 0), (6, None, None), (7, None, None), (8, "02020202", 0)], key=str)
    assert vector_codes.compress(frame_of(spark, [])).count() == 0
    assert vector_codes.compress(frame_of(spark, [(1, None, 1)])).count() == 0
    assert [(r.code, r.error) for r in vector_codes.compress(frame_of(spark, [(1, [], 1)])).collect()] == [(None, None)]


def test_walk_shares_prefixes_and_agrees_with_all_distances():
    rng = np.random.default_rng(1)
    parts = np.unique(rng.integers(-3, 4, (3000, 6)), axis=0)
    book = rng.integers(-3, 4, (256, 6))
    entry, error = vector_codes.walk(parts, book)
    all_of = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == all_of.argmin(axis=1)).all() and (error == all_of.min(axis=1)).all()


@here
@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_filter_audit", "op13_vector_codes"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, row)) for row in cursor.fetchall()]
    frame = queries.QUERIES[name](spark, SF)
    made = [r.asDict() for r in frame.select(*names).collect()]
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(str, made)) == sorted(map(str, want))


# ------------------------------------------------------------------ layouts of chat records


U, A = ("user", "q"), ("assistant", "a")
FORMS = [
    ({"id": 1, "prompt": "q", "response": "a"}, [U, A]), ({"id": 1, "question": "q", "answer": "a", "source": {"x": [1]}}, [U, A]),
    ({"id": "z", "instruction": "q", "input": "", "output": "a"}, [U, A]), ({"instruction": "q", "input": "more", "output": "a", "n": 2}, [("user", "q\n\nmore"), A]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), U, A]),
    ({"id": 3, "system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "s"), U, A]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}, {"role": "assistant", "content": "a", "weight": 1}]}, [("user", "q\nr"), A]),
    ({"prompt": "q", "response": "a", "answer": None}, [U, A]), ({"prompt": "q", "completion": "a", "system": "s", "id": 1}, [U, A]),
    ({"messages": [], "id": 1}, []), ({"system": "s", "prompt": "q", "response": "a", "tags": []}, [("system", "s"), U, A]),
    ({"messages": [{"role": "user", "content": "q"}], "prompt": "p", "response": "r"}, [U]), ({"prompt": "q"}, []), ({"a": {"prompt": "q", "response": "a"}}, []),
]


@pytest.mark.parametrize("k", range(len(FORMS)))
def test_layouts_with_more_fields_than_a_mapping_names(k):
    record, turns = FORMS[k]
    _, name, got = chat_format.canonical(json.dumps(record))
    assert got == turns and bool(name) == (bool(turns) or "messages" in record)


@pytest.mark.parametrize("record", ["[" * 100_000, '{"a":' * 100_000, '{"prompt": ' + "[" * 900 + "]" * 900 + ', "response": "a"}', "[1]", "3", ""])
def test_deep_or_odd_records_do_not_crash(record):
    assert chat_format.canonical(record)[0] is not None
    nested = {"a": None}
    for _ in range(50_000):
        nested = {"a": nested}
    assert len(chat_format.field_paths(nested)) == 1


# ------------------------------------------------------------------ secrets that used to stay


LEAKS = [
    ("Authorization: Bearer abcdefGHI123456789", ["abcdefGHI123456789"]), ('auth_token = os.environ.get("TOKEN_NAME_X", "Zx81kQ977tail")', ["Zx81kQ977tail"]),
    ('credentials = ["Zx81-kQ9ab", "b"]', ["Zx81-kQ9ab", "b"]), ("<password>hunter2xyz</password>", ["hunter2xyz"]),
    ('private_key = part\npart = "Zx81-kQ9ab"\n', ["Zx81-kQ9ab"]), ("const secretKey = process.env.SECRET_KEY || 'Zx81kQ977tail'", ["Zx81kQ977tail"]),
    ("api_key: Token 9f8a7b6c5d4e3f2a1b", ["9f8a7b6c5d4e3f2a1b"]), ("<item>plain words here</item> <secret></secret>", []), ("private_key = part\nother = 'Zx81-kQ9ab'", []),
]


@pytest.mark.parametrize("k", range(len(LEAKS)))
def test_secrets_that_used_to_stay(k):
    text, want = LEAKS[k]
    spans, _ = secret_scan.spans_of(text)
    assert [text[a:b] for a, kind, b in spans if kind == 3] == want
    assert not any(w in secret_scan.redacted(text) for w in want if len(w) > 1)


@pytest.mark.parametrize("line", ['{\\"key\\": \\"value one\\", \\"n\\": 12}, ', "it's; x=\"a ", "x=(\"a' ", "token: ['b', "])
def test_open_quotes_do_not_make_the_scan_quadratic(line):
    times = []
    for n in (2_000, 16_000):
        text = 'data: "' + line * n
        began = time.perf_counter()
        secret_scan.spans_of(text)
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0] + 0.5  # eight times the text; 64 if it were quadratic


def test_labels_of_many_languages_do_not_wrap():
    scores = np.full((6, 300), -5.0, np.float32)
    scores[[0, 1, 2], 270] = scores[[3, 4, 5], 150] = 0.0
    assert lang_id.viterbi(scores, np.array([3, 3]), 2.0).tolist() == [270] * 3 + [150] * 3
