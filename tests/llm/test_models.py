"""Classifiers, near-duplicates, personal data and the pipeline against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import bagminhash, common, pii_labelers, registry, subword_quality, toxicity_neighbours
from eventide.llm.common import pieces


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


# --- toxicity and quality ------------------------------------------------------------------------------------

@pytest.mark.parametrize(("call", "column", "threshold", "auc"), [(toxicity_neighbours.score_toxicity, 2, 0.3, 0.75), (subword_quality.classify_quality, 1, 0.7, 0.95)])
def test_classifier_held_out(spark, call, column, threshold, auc):
    """Held-out accuracy well above the share of the commoner label, and the order of the scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = call(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    judged = []
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        if r["held_out"] and r["doc_id"] in known:
            judged.append((known[r["doc_id"]], r["predicted"], r["score"]))
    share = np.mean([y for y, _, _ in judged])
    assert np.mean([y == p for y, p, _ in judged]) > max(share, 1 - share) + 0.05
    yes, no = ([s for y, _, s in judged if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > auc


@pytest.mark.parametrize("call", [toxicity_neighbours.score_toxicity, subword_quality.classify_quality])
def test_classifier_odd_input(call, odd_docs, make_docs, labels, real):
    for table in ([], [(0, 1, 0)], [(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None), (1, 0, 0)]):
        rows = call(odd_docs, labels(table)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert call(make_docs([]), real("labels")).count() == 0


@pytest.mark.parametrize("call", [toxicity_neighbours.score_toxicity, subword_quality.classify_quality])
def test_held_out_labels_are_never_learned(call, make_docs, labels):
    texts = [("good words in a row here " if i % 2 else "#### bad $$$ idiot %%% ") * 5 + f"n{i}" for i in range(60)]
    docs = make_docs(texts)
    right = [(i, i % 2, 1 - i % 2) for i in range(60)]
    turned = [(i, q if fold(i) != 2 else 1 - q, t if fold(i) != 2 else 1 - t) for i, q, t in right]
    a, b = ({r["doc_id"]: r["score"] for r in call(docs, labels(x)).collect()} for x in (right, turned))
    assert a == pytest.approx(b)


def _index(texts):
    value, row = toxicity_neighbours.term_counts(pa.array(texts))
    known, at = np.unique(value, return_inverse=True)
    key, count = np.unique(row.astype(np.int64) * len(known) + at, return_counts=True)
    row, term = key // len(known), key % len(known)
    idf = np.log((len(texts) + 1) / (np.bincount(term, minlength=len(known)) + 1)) + 1e-3
    weight = toxicity_neighbours.weigh(row, term, count, idf, len(texts))
    dense = np.zeros((len(texts), len(known)), dtype=np.float32)
    dense[row, term] = weight
    ids = np.arange(len(texts))[::-1].copy()
    return toxicity_neighbours.BlockMaxIndex(row, term, weight, np.arange(len(texts)) % 2, ids, len(known)), dense, (row, term, weight), ids


@pytest.mark.parametrize("k", [3, 80])
def test_block_max_search_is_exact(k):
    """Against all cosines of the same sparse vectors, every term kept; ties go to the smaller id."""
    rng = random.Random(2)
    topics = [[f"{t}{'abcdefghij'[rng.randrange(10)]}{rng.randrange(40)}" for _ in range(60)] for t in ("uno", "due", "tre")]
    texts = [" ".join(rng.choice(topics[i % 3]) for _ in range(rng.choice([0, 3, 30, 80]))) for i in range(400)]
    texts += texts[:50]
    index, dense, query, ids = _index(texts)
    best, place = index.search(*query, len(texts), k)
    assert index.visited < index.blocks * len(texts)  # some blocks are skipped
    for i in range(len(texts)):
        cosine = dense @ dense[i]
        want = sorted(((-round(float(c), 4), int(ids[j])) for j, c in enumerate(cosine) if c > 1e-6))[:k]
        got = [(c, int(index.ids[p])) for c, p in zip(best[i], place[i], strict=True) if p >= 0]
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want], abs=2e-4)
        exact = {int(ids[j]): float(c) for j, c in enumerate(cosine)}
        assert all(abs(exact[j] - c) < 1e-5 for c, j in got)
        assert got == sorted(got, key=lambda x: (-x[0], x[1]))


def test_search_leaves_the_own_example():
    index, _, (row, term, weight), ids = _index(["one two three", "one two four", "five"])
    own = np.array([int(np.flatnonzero(index.ids == i)[0]) for i in ids])
    _, place = index.search(row, term, weight, 3, 5, leave=own)
    assert [sorted(index.ids[p[p >= 0]].tolist()) for p in place] == [[1], [2], []]


def test_sampled_id_on_many_rows_counts_once(make_docs, labels):
    docs = make_docs(["bad idiot words"] * 50 + ["good clean words"] * 50, [1] * 50 + list(range(50, 100)))
    rows = toxicity_neighbours.score_toxicity(docs, labels([(1, 1, 1), *[(i, 1, 0) for i in range(50, 100)]])).collect()
    assert len(rows) == 100 and all(len({e["doc_id"] for e in r["evidence"]}) == len(r["evidence"]) for r in rows)


def test_subword_features_ignore_piece_borders():
    texts = ["alpha beta beta", "", "x", "ab", "gamma\ndelta", "beta beta"]
    whole = [sum(np.bincount(b[s[r] : s[r + 1]], minlength=subword_quality.BUCKETS) for b, s in subword_quality.features(pa.array(texts))) for r in range(len(texts))]
    for t, w in zip(texts, whole, strict=True):
        alone = sum((np.bincount(b, minlength=subword_quality.BUCKETS) for b, _ in subword_quality.features(pa.array([t]))), np.zeros(subword_quality.BUCKETS, int))
        assert (alone == w).all()


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 10, 5, 100, 0, 3)] + [None]})
    for size in (1, 11, 1000):
        got = [x for p in pieces(iter([batch]), "text", size) for x in p.column("text").to_pylist()]
        assert got == batch.column("text").to_pylist()


# --- near-duplicates -----------------------------------------------------------------------------------------

def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    """Partition of row positions: equal texts and all pairs at 0.8 or more, transitively."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first, bags, seen = {}, [], defaultdict(list)
    for i, (_, t) in enumerate(rows):
        t = t or ""
        bags.append(bag(t))
        if t in first:
            root[find(i)] = find(first[t])
            continue
        first[t] = i
        for j in {j for s in bags[i] for j in seen[s]}:
            if jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
        for s in bags[i]:
            seen[s].append(i)
    return [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies(make_docs):
    """Exact copies, near ones on both sides of the threshold, a large group and a passage that many share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        texts += [" ".join(base)] * 2
        for _ in range(4):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other).capitalize())
    group = [word() for _ in range(200)]
    for _ in range(150):
        other = list(group)
        for _ in range(3):
            other[rng.randrange(200)] = word()
        texts.append(" ".join(other))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(80)]
    return make_docs(texts)


def test_near_duplicates(copies, odd_docs, real):
    for docs in (copies, odd_docs, real("documents")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = brute_classes(rows)
        names = defaultdict(list)
        for (d, _), c in zip(rows, want, strict=True):
            names[c].append(d)
        least = {c: min((d for d in ids if d is not None), default=None) for c, ids in names.items()}
        assert Counter((r["doc_id"], r["class_id"]) for r in bagminhash.find_near_duplicates(docs).collect()) == Counter((d, least[c]) for (d, _), c in zip(rows, want, strict=True))
        kept = bagminhash.drop_near_duplicates(docs, docs.columns).collect()
        assert len(kept) == len(names)


def test_near_duplicates_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d"), (2, text + " more", "a", "b", "c", "d"), (2, text + " more", "a", "b", "c", "d"), (3, "other", "a", "b", "c", "d")], "doc_id bigint, text string, own_key string, class_key string, _id string, class_id string")
    kept = bagminhash.drop_near_duplicates(docs, docs.columns).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and kept[0].asDict().keys() == set(docs.columns)


def test_near_duplicates_stage_few_files(spark, make_docs, tmp_path, monkeypatch):
    """However many partitions: every file is a launched process, and an executor that launches one is seen at twice its size."""
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    before = {k: spark.conf.get(k, None) for k in own}
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(40)]
    docs = make_docs([t + tail for t in texts for tail in ("", " z", " y x", "")]).repartition(4)
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = dict(bagminhash.find_near_duplicates(docs).collect())
        bagminhash.drop_near_duplicates(docs, docs.columns).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(set(got.values())) == 40 and all(c == d // 4 * 4 for d, c in got.items())
    tables = {p.name: [f.name for f in p.iterdir()] for p in tmp_path.iterdir()}
    assert {n.split("-")[0] for n in tables} >= {"signed", "representatives", "buckets", "star_pairs", "elements", "star_links", "placed", "inside_links", "kept"}
    for name, files in tables.items():
        assert len(files) <= {"signed": 4, "elements": 8, "cross_elements": 8}.get(name.split("-")[0], 2), name
        assert all(f.startswith("part-") for f in files), name


def test_near_duplicates_empty(make_docs):
    assert bagminhash.find_near_duplicates(make_docs([])).count() == 0
    assert bagminhash.drop_near_duplicates(make_docs([]), ["doc_id", "text"]).count() == 0


def test_signatures_are_unbiased():
    rng = random.Random(3)
    errors = []
    for k in range(150):
        a = [f"w{rng.randrange(60)}" for _ in range(100)]
        a = a[:30] * rng.randint(1, 6) + a[30:]
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            b[rng.randrange(len(b))] = f"z{rng.randrange(9)}"
        b += b[: 20 * (k % 3)]
        pair = pa.array([" ".join(a), " ".join(b)])
        row, value = bagminhash.shingles(pair)
        s, e = bagminhash.signatures(row, value, 2), bagminhash.elements(row, value, 2)
        true = jaccard(bag(pair[0].as_py()), bag(pair[1].as_py()))
        assert bagminhash.similarity(*e) == pytest.approx(true)
        errors.append(float((s[0] == s[1]).mean()) - true)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: min(y for y in root if find(y) == find(x)) for e in edges if e[0] != e[1] for x in e}
    assert {r["rid"]: r["cls"] for r in bagminhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want


# --- personal data -------------------------------------------------------------------------------------------

def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii_labelers.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii_labelers.KINDS.index(s[0])))


def test_base_spans_random():
    rng = random.Random(1)
    parts = ["a", "b@", "@", "c.d", "-", ".", "1", "22", "+1", "4111 1111 1111 1111", "256.1.1.1", "1.2.3.4", " ", "(", ")", "é", "%", "+1 (269) 555-3296"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii_labelers.base_spans(t) == brute_spans(t), t


def test_base_spans_of_long_digits_take_linear_time():
    import time

    for text in ("1" * 300_000, "1." * 200_000, "0" * 5000 + ".1.1.1", "1 " * 200_000, "+1 " * 100_000, "+" + "1" * 200_000, "a@" * 200_000, "1-" * 200_000 + "x", "a." * 100_000 + "@b.c"):
        begin = time.perf_counter()
        spans = pii_labelers.base_spans(text)
        assert time.perf_counter() - begin < 6, text[:10]
        assert pii_labelers.candidates(text[:20_000], []) is not None
    assert ("ip", 0, 5006) in pii_labelers.base_spans("0" * 5000 + ".1.1.1")


def test_redaction_keeps_the_type_of_n_chars(spark):
    for kind in ("int", "bigint", "string", "smallint"):
        docs = spark.createDataFrame([(1, "mail a@b.org now", "9")], "doc_id bigint, text string, n_chars string").selectExpr("doc_id", "text", f"cast(n_chars as {kind}) n_chars")
        out = pii_labelers.redact(docs, docs.columns)
        assert out.schema == docs.schema and str(out.first()["n_chars"]) == "16"


def test_personal_data(real, odd_docs, make_docs):
    extra = make_docs(["call +1 (269) 555-3296 4524132264652876 now", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', "IBAN DE89 3704 0044 0532 0130 00 here", "no data at all"], range(700, 704))
    docs = real("documents").select("doc_id", "text").unionAll(odd_docs.select("doc_id", "text")).unionAll(extra.select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        spans = brute_spans(r["text"] or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(r["doc_id"], *(sum(s[0] == k for s in spans) for k in pii_labelers.KINDS), hashlib.sha256(shown.encode()).hexdigest())] += 1
    rows = pii_labelers.find_personal_data(docs).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert "tel:5:22" in spans[700] and "secret:9:49" in spans[701] and "account:5:32" in spans[702] and spans[703] == ""
    for r in rows:
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_redaction(odd_docs, make_docs):
    docs = odd_docs.unionAll(make_docs(["mail a@b.org and 1.2.3.4!"], [800]))
    rows = pii_labelers.redact(docs, docs.columns).collect()
    assert len(rows) == docs.count()
    got = next(r for r in rows if r["doc_id"] == 800)
    assert got["text"] == "mail [email] and [ip]!" and got["n_chars"] == len(got["text"])
    assert all(not pii_labelers.base_spans(r["text"] or "") for r in rows)
    assert pii_labelers.find_personal_data(make_docs([])).count() == 0 and pii_labelers.redact(make_docs([]), ["text"]).count() == 0


@pytest.mark.parametrize(("text", "kind"), [
    ("token=ghp_a1B2c3D4e5F6g7H8i9J0k1L2", "secret"), ("key sk-a1b2c3d4e5f6g7h8i9j0kZ", "secret"), ("mac a1:b2:c3:d4:e5:f6 host", "machine"),
    ("mac aa-bb-cc-dd-ee-ff host", "machine"), ("inet fe:ab:cd:ef:fe up", "machine"),
])
def test_candidates_without_adjacent_digits(text, kind):
    assert [c[0] for c in pii_labelers.candidates(text, [])] == [kind]


def test_clue_never_hides_a_candidate():
    rng = random.Random(5)
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(1, 40))) for p in ["abF:-", "aF1:- ", "aZ1_-+ .()", "DE1 0A", "01 -"] for _ in range(2_000)]
    hidden = [t for t in texts if pii_labelers._CANDIDATE.search(t) and not pii_labelers._CLUE.search(t)]
    assert not hidden and any(pii_labelers._CANDIDATE.search(t) for t in texts)


def test_redaction_without_adjacent_digits(make_docs):
    rows = pii_labelers.redact(make_docs(["token=ghp_a1B2c3D4e5F6g7H8i9J0k1L2"] * 30 + ["nothing-of-note-4-anyone-here"] * 30), ["text"]).collect()
    assert Counter(r["text"] for r in rows) == {"token=[secret]": 30, "nothing-of-note-4-anyone-here": 30}


def test_reliabilities_tell_labelers_apart():
    counts = {}
    for key, n in (('["secret",[1,1,1,0,1,0,0,0],[1,0,1,1,0,0,4,3,3,2,1,0,0,0,0,1]]', 80), ('["secret",[0,0,0,0,-1,-1,-1,0],[0,0,0,0,0,0,2,0,1,1,0,0,0,0,0,1]]', 200)):
        counts[key] = n
    p = list(pii_labelers.train(counts).values())
    assert {round(x) for x in p} == {0, 1} and pii_labelers.train({}) == {}


# --- pipeline and registry -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from eventide.llm.bpe_chunks import ChunkCoder, default_path
    from eventide.llm.decontamination import find_contamination

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity_neighbours.score_toxicity(docs, labels).collect()}
    state, coder = [r for r in docs.collect() if not scores[r["doc_id"]]], ChunkCoder(default_path())
    read, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, read, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        rows = read.collect()
        sizes.append(len(rows))
        if k < len(pipeline.STAGES) - 1:
            assert read.columns == docs.columns
        if k == 0:
            assert sorted(rows) == sorted(state)
        elif k == 1:
            cls = brute_classes([(r["doc_id"], r["text"]) for r in state])
            assert sorted(r["doc_id"] for r in rows) == sorted(min(state[i]["doc_id"] for i in range(len(state)) if cls[i] == c) for c in set(cls))
        elif k == 2:
            bad = {r["doc_id"] for r in find_contamination(docs, bench).where("contaminated").collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in state} - bad
        elif k == 3:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in state} and all(not brute_spans(r["text"] or "") for r in rows)
        else:
            want = {(r["doc_id"], *(lambda n, ids, shown: (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))(*(coder.whole(r["text"]) if r["text"] else (0, "", "")))) for r in state}
            assert {tuple(r) for r in rows} == want
        state = rows
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_odd_tables(spark, sf_dir, tmp_path, empty):
    """Nulls, long digits, copies, columns with the operators' own names, n_chars as int; and no documents at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from eventide.llm.bpe_chunks import ChunkCoder, default_path

    schema = "doc_id bigint, text string, n_chars int, _words string, items string, spans string, class_id string, own_key string, score string, label string, n_tokens string"
    texts = [] if empty else [None, "", None, "7" * 30_000, "1.2.3.4 and a@b.org", "plain words here", "plain words here", "x " * 5000, "é" * 3000, "<|endoftext|> inside"]
    spark.createDataFrame([(i, t, len(t or ""), *"abcdefgh") for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    coder = ChunkCoder(default_path())
    kept = {0: "", 3: "7" * 30_000, 4: "[ip] and [email]", 5: "plain words here", 7: "x " * 5000, 8: "é" * 3000, 9: "<|endoftext|> inside"}  # null and empty texts are copies
    assert {i: (r["n_tokens"], r["ids_sha256"]) for i, r in got.items()} == ({} if empty else {i: (lambda c: (c[0], hashlib.sha256(c[1].encode()).hexdigest()))(coder.whole(t) if t else (0, "", "")) for i, t in kept.items()})


def test_registry_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
