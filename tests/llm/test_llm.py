"""Each text operator against SQL or a brute-force version, on the small tables and on odd cases."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
pytest.importorskip("riskbridge.llm")
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from riskbridge.llm import bpe, columns, decontaminate, exact_dedup, html_text, language_id, pii, queries, simhash, spans, toxicity  # noqa: E402
from riskbridge.llm.common import table  # noqa: E402

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again until it is tired of it"), (2, "The quick  brown\nfox jumps over the lazy dog again and again until it is tired of it"),
    (3, None), (4, ""), (5, " "), (6, "short"), (None, "a null id"), (7, "The quick brown fox jumps over the lazy dog again and again until it is tired of it"),
    (7, "The quick brown fox jumps over the lazy dog again and again until it is tired of it"), (8, "x " * 20_000), (9, "12345 !!"), (10, "é ñ ü " * 50),
    (11, "y" * 50_000), (12, "write to a.b@c.example.com from 10.0.0.255 or +1 (632) 555-4827 with 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, "r", i, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, `h` bigint, `key` int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (2, "12345"), (3, None), (4, "!"), (5, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    names, _, expected = compare.oracle(compare.connect(SF), queries.oracle_sql()[name])
    assert compare.difference(compare.canonical(df.columns, [tuple(r) for r in df.collect()]), compare.canonical(names, expected)) is None


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


# ---- exact dedup


def test_exact_groups(odd, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    same = [r for r in got.values() if r.group_size == 4]
    assert {r.doc_id for r in same} == {1, 2, 7} and all(r.keep_id == 1 and r.kept == (r.doc_id == 1) for r in same)
    assert sum(r.keep_id == 3 for r in got.values()) == 2  # null and empty texts
    assert [r.kept for r in got.values() if r.doc_id is None] == [True]
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4


def test_colliding_hashes_are_told_apart(odd):
    from pyspark.sql import functions as F

    weak = lambda text: F.unhex(F.substring(F.md5(text), 1, 1))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(exact_dedup.exact_groups(odd, weak).collect(), key=key) == sorted(exact_dedup.exact_groups(odd).collect(), key=key)
    assert exact_dedup.exact_dedup(odd, weak).count() == exact_dedup.exact_dedup(odd).count()


# ---- decontamination


def brute_hits(text, items, n=10):
    told = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    w, hit, found = told(text), set(), set()
    for i, item in items:
        v = told(item)
        if not v:
            continue
        k = min(n, len(v))
        grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
        for j in range(len(w) - k + 1):
            if tuple(w[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(odd, empty, bench, spark):
    items = [tuple(r) for r in bench.collect()]
    want = sorted(brute_hits(t, items) for _, t in ODD)
    assert sorted(tuple(r)[1:] for r in decontaminate.contamination(odd, bench).collect()) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.filter("false")).collect())
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not w[-1] for w in want)


def test_winnowing_misses_nothing(spark):
    rng = random.Random(2)
    pool = "a b c".split()
    texts = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(20)]
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {i: brute_hits(t, items) for i, t in texts}


# ---- spans and bytes


def brute_spans(rows, n=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone |= set(range(j, j + n))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def brute_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(b[p : p + n])
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {i: sorted(v) for i, v in out.items()}


def passages(seed):
    """Texts around a few common lines, so that anchors are shared by many different passages."""
    rng = random.Random(seed)
    line = [" ".join(rng.choice(["al", "be", "ce", "de"]) for _ in range(k)) for k in (6, 9, 14, 30)]
    far = lambda: " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 20)))
    return [(i, " ".join(x for _ in range(rng.randint(0, 3)) for x in (far(), rng.choice(line), far()) if x)) for i in range(150)]


@pytest.mark.parametrize("crowd", [48, 2])
def test_spans_with_crowded_anchors(spark, crowd):
    rows = passages(1)
    got = by_id(spans.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), crowd=crowd).drop("kept"))
    assert got == brute_spans(rows)


@pytest.mark.parametrize("crowd", [48, 2])
def test_bytes_with_crowded_anchors(spark, crowd):
    rows = passages(2)
    got = by_id(columns.byte_digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), crowd=crowd))
    assert got == {i: [v] for i, v in brute_bytes(rows).items()}


def test_spans_and_bytes_odd(odd, empty):
    big = [(1 << 62 if i is None else i, t) for i, t in ODD]
    want = brute_spans(big)
    assert {1 << 62 if i is None else i: v for i, v in by_id(spans.shared_spans(odd).drop("kept")).items()} == want
    once = odd.dropDuplicates(["doc_id"])
    got = by_id(columns.byte_digests(once))
    want = brute_bytes({1 << 62 if r.doc_id is None else r.doc_id: r.text for r in once.collect()}.items())
    assert {1 << 62 if i is None else i: v[0] for i, v in got.items()} == want
    assert spans.shared_spans(empty).count() == 0 and columns.byte_digests(empty).count() == 0


def test_bytes_small_table(spark, docs):
    got = by_id(queries.queries()["op7_columns"](spark, SF))
    assert got == {i: [v] for i, v in brute_bytes(docs.items()).items()}


# ---- SimHash


def brute_print(text, n=3):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints(docs):
    texts = [*list(docs.values())[:60], *[t for _, t in ODD]]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("cell_pairs", [32, 1])
def test_close_pairs_join_all(spark, cell_pairs):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint"), cell_pairs=cell_pairs)
    got = {tuple(sorted((r.a, r.b))) for r in pairs.collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert all(roots[a] == roots[b] for a, b in want) and set(roots) == {x for p in want for x in p}


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_odd(odd, empty):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert got[4, "0" * 16] == 3 and got[7, f"{brute_print(ODD[0][1]):016x}"] == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    stay = simhash.near_dedup(odd)
    assert stay.columns == odd.columns and 7 not in {r.doc_id for r in stay.collect()}


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, simhash.near_dedup])
def test_rows_stay_by_content(spark, dedup):
    a, b = "one text of some words that stays as it is", "an unlike text that shares the id of another row"
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "de"), (1, b, "en"), (2, a, "en"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (None, "null id", "y"), (None, "null id", "y")]
    got = [tuple(r) for r in dedup(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()]
    assert len(got) == 4 and {(i, t) for i, t, _ in got} == {(1, a), (1, b), (3, None), (None, "null id")}


def test_near_stage_keeps_one_of_each_component(spark, docs):
    stay = {r.doc_id for r in simhash.near_dedup(table(spark, SF, "documents")).collect()}
    assert stay == {r.component_id for r in simhash.near_duplicates(table(spark, SF, "documents")).collect()}


# ---- language


def test_language_costs_are_code_lengths():
    model = language_id.fit({"x": ["abcabcabd " * 20], "y": ["zzyzzy é" * 20]}, least=1)
    p = np.exp(-model.bits.astype(float)).reshape(-1, language_id.ALPHABET, 2)
    assert np.allclose(p.sum(1), 1, atol=1e-4)  # each context gives a whole distribution
    texts = pa.array(["abc", None, "", "zzyé abcabd" * 40])
    assert np.allclose(model.costs(texts), model.costs(texts, step=7))
    one = model.costs(pa.array(["abc"]))[0]
    s = language_id.coded(np.frombuffer(b"abc", np.uint8))
    c = language_id.contexts(s, np.array([0]))
    assert np.allclose(one, model.bits[model.state[c] * language_id.ALPHABET + s].sum(0))


def test_language_held_out(spark, odd, empty):
    rows = language_id.language_of(table(spark, SF, "documents")).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language_id.language_of(odd).collect()}
    assert got[3] == got[4] == got[9] == "und" and got[1] == "en"
    assert language_id.language_of(empty).count() == 0
    kept = language_id.with_language(odd)
    assert kept.columns == odd.columns and not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}


# ---- BPE


def test_bpe_equals_library(docs, spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    v = bpe.Vocabulary(Path(path).read_text(encoding="utf-8"), words_kept=50)
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdeth nis'.!éñß中😀Σ \n0123<|") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for text in [*list(docs.values())[:30], *made, *[t or "" for _, t in ODD], "I'll<|endoftext|>'s <|startoftext|>", "ΑΣ İ ①²\x1c\x85x", "aaaa" * 30]:
        want = library.encode(text, add_special_tokens=False).ids
        got = v.encode(text)
        assert got.tolist() == want and v.decode(got).decode() == library.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.tokenize(odd, path).collect()}
    assert rows[3].ids == rows[4].ids == [] and rows[3].decoded == "" and rows[1].n_tokens == len(rows[1].ids)
    assert bpe.token_digests(empty, path).count() == 0


# ---- personal data


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else None, 12 <= len(digits(m)) <= 19 and luhn(digits(m)), 9 <= len(digits(m)) <= 15)[k]
            out += [(m.start(), k, m.end())] if ok else []
    out.sort()
    return [sum(o[1] == k for o in out) for k in range(4)] + [hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in out).encode()).hexdigest()]


def test_pii(spark, odd, empty):
    rng = random.Random(3)
    parts = ["a", "b@c.d", "@", "x.y", "..", ".", "1", "255", "1.2.3.4", "+", "-", " ", "(", ")", "4111111111111111", "é", "😀", "\n", "%", "_", "+1 (632) 555-4827", "@x.y.z"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(400)}
    texts |= {900: None, 901: "1" * 30_000, 902: "1 " * 20_000, 903: "a@" + "b." * 20_000 + "c", 904: "1.1.1.1 " * 2000, 905: "+1" + "." * 9000 + "2"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in pii.personal_data(df).collect():
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == brute_pii(texts[r.doc_id]), texts[r.doc_id]
    got = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    assert got[12].spans.count(":") == 8 and pii.personal_data(empty).count() == 0


def test_pii_trees_add_what_looks_alike():
    base = dict(kind=3, digits=10, longest=4, marks=2, brackets=1, dots=0, before=1, after=1, word=1)
    rows = [base | dict(fold=f, n=100, good=99) for f in (0, 1)] + [base | dict(brackets=0, fold=f, n=100, good=2) for f in (0, 1)]
    model = pii.boosted(rows)
    assert set(model.threshold) == {3} and model.threshold[3] > 0


# ---- pages


PAGE = "<html><body><nav>menu</nav><div class='post-{0}'><h1>T{0} &amp; x</h1><p>one<br> two<p>three <b>bold<ul><li>a<li>b</ul><div class=comments>bad</div></div><aside>no</aside><form>f</form><script>if (a<b) x('</p>')</script><footer>f</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://H.example.com/{i}", PAGE.format(i)) for i in range(4)] + [(4, None, None), (5, "x", ""), (6, "http://h.example.com/z", "<p>own &lt;text&gt;<p>5 < 6"), (6, "http://h.example.com/z", "<p>own &lt;text&gt;<p>5 < 6")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id bigint, url string, html string, host int, path string")
    got = [tuple(r) for r in html_text.extract(df).collect()]
    text = {r[0]: r[2] for r in got}
    assert text[1] == "T1 & x\n\none two\n\nthree bold\n\na\n\nb" and text[4] == text[5] == "" and text[6] == "own <text>\n\n5 < 6"
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    assert [r.path for r in html_text.host_paths(df).filter("host = 'h.example.com'").collect()] == ["/div.post-#"]
    assert html_text.extract(df.filter("false")).count() == 0


# ---- toxicity


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity._new(rng).items()})
    net.p["vectors"] = rng.normal(0, 0.3, net.p["vectors"].shape)
    which, text, slots = toxicity.words(*toxicity.utf8(pa.array(["bad words here", "good ones are there too"])))
    win, of = toxicity.windows(which, text, 2)
    win, label = win[:, :6], np.array([1.0, 0.0])[of]

    def loss():
        parts = net._inputs(slots)[win.T] @ net.p["enter"] + net.p["bias"]
        h = toxicity.HIDDEN
        states = np.concatenate([toxicity._gru(parts[:, :, : 3 * h], net.p["u_ahead"]), toxicity._gru(parts[::-1, :, 3 * h :], net.p["u_back"])[::-1]], 2)
        z = net._pooled(states)[2] @ net.p["out"] + net.p["out_bias"]
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    grad = net.gradients(slots, win, label)
    for name in ("u_ahead", "u_back", "enter", "attend", "focus", "out", "pad", "bias"):
        at = (0,) * net.p[name].ndim
        kept, step = net.p[name][at], 3e-3
        net.p[name][at] = kept + step
        up = loss()
        net.p[name][at] = kept - step
        down = loss()
        net.p[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=0.05), name


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    clean = ["the", "on", "it", "was", "there", "house", "green", "walks"]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(rng.randint(0, 120))]
        if i % 4 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "moronic", "scumbag"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 500 and {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95 and all(r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.toxicity(odd, lab.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(odd, lab.filter("false")).count() == len(ODD)


# ---- pipeline


def test_pipeline(spark, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "benchmark decontamination", "BPE"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd, empty):
            assert stage(spark, rows, SF).columns == rows.columns, name
            assert stage(spark, rows, SF).count() <= rows.count()
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    kept = {r.doc_id for r in exact_dedup.exact_groups(table(spark, SF, "documents")).filter("kept").collect()}
    bad = {r.doc_id for r in decontaminate.contamination(table(spark, SF, "documents"), table(spark, SF, "benchmark")).filter("contaminated").collect()}
    assert len(ids) == len(set(ids)) and set(ids) <= kept - bad and len(ids) > 0.9 * len(kept - bad)
    assert all(r.n_tokens == len(r.ids) for r in out)
