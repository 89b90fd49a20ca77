"""The operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.llm import exact_dedup, lm_scoring, mixing, near_dedup, neighbours, packing, quality, token_counts, toxicity, url_filter
from satchel.llm import queries as llm_queries
from satchel.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, block int, row_id long, size long, n long, key long, __words string, target double, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", "", " \n\t ", "One", "one", "ONE two", base, base.upper(), near, base + " tail", "x" * 9000, prose(rng, 6000), "É é", "é É", "a  b\n\nc  ", "<|endoftext|> <s> ▁"]
    texts += [prose(rng, 40) for _ in range(40)] + [prose(rng, 30) + " shared"] * 6
    out = [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}") for k, t in enumerate(texts)]
    out += [(None, "one", None, "s1"), (None, prose(rng, 20), "en", "s1"), out[7], out[7]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = ("nm", 1, 2, 3, 4, 5, "w", 0.5, 1)
    return spark.createDataFrame([(i, t, lang, s, None, *more) for i, t, lang, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 4 > 0, k % 5 == 0) for k in range(60)] + [(3, True, True), (None, True, False), (5, None, None)], "doc_id long, quality boolean, toxic boolean").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("block_chars", [4096, 50])
def test_exact_dedup(docs, rows, nothing, block_chars):
    got = exact_dedup.exact_dedup(docs, block_chars).collect()
    assert len(got) == len(rows)
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256(lowered(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_dedup(nothing).count() == 0
    left = exact_dedup.drop_exact_copies(docs, block_chars)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_exact_copies_with_string_ids(spark):
    rows = [("b", "One"), ("a", "one"), ("0", "two"), (None, "two"), (None, "three"), ("0", "two")]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([("b", "One"), ("0", "two"), (None, "three")], key=str)


def shingles(text, width):
    w = lowered(text).encode().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, nothing, width):
    got = near_dedup.near_duplicates(docs, width).collect()
    assert len(got) == len(rows)
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def top(k):
        return k if parent[k] == k else top(parent[k])

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[top(a)] = top(b)
    want = Counter()
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if top(m) == top(k)] if s else [i]
        want[i, len(s), min((x for x in ids if x is not None), default=None)] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert near_dedup.near_duplicates(nothing, width).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """Copies of one text, with each other below the threshold: every pair is checked, none is missed."""
    rng = random.Random(9)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(2, 14)):
            w[k] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
    sets = [shingles(t, 2) for t in texts]
    want = list(range(len(texts)))
    for _ in range(8):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    want[a] = min(want[a], want[b])
    assert [got[k] for k in range(len(texts))] == want


def test_near_dedup_repeats_and_drop(spark):
    """A row repeated 1,000 times is one class; the filter keeps all rows of a component's id, nulls and empty texts too."""
    rng = random.Random(12)
    text = prose(rng, 50)
    rows = [(5, text)] * 1000 + [(3, text + " more"), (9, text.upper()), (None, None), (None, text), (7, ""), (8, prose(rng, 50))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cls long, comp string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == Counter({(5, 3, False): 1000, (3, 3, True): 1, (9, 3, False): 1, (None, None, True): 1, (None, 3, False): 1, (7, 7, True): 1, (8, 8, True): 1})
    kept = near_dedup.drop_near_copies(docs, 2)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 7, 8} and not {r.doc_id for r in kept.collect()} & {5, 9}
    assert near_dedup.drop_near_copies(docs.limit(0), 2).count() == 0


def test_bucket_bound(spark):
    """The bound never exceeds the true distance, also for sets whose buckets overflow."""
    rng, shingler = np.random.default_rng(3), near_dedup._shingler(2)
    for size in (1, 40, 3000, 300_000):
        x = np.unique(rng.integers(0, 2**64, size, np.uint64))
        y = np.unique(np.r_[x[: max(1, 9 * size // 10)], rng.integers(0, 2**64, size // 10, np.uint64)])
        shared = len(np.intersect1d(x, y))
        true = 1e6 * (1 - shared / (len(x) + len(y) - shared))
        d = near_dedup._distance(np.array([len(x)]), np.array([len(y)]), shingler.buckets(x)[None], shingler.buckets(y)[None])
        assert d[0] <= true


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (101, 90), (102, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (90, 100, 101, 102)} == {90}


def test_url_filter(spark):
    page = '<link href="{}" rel=canonical>'
    go = '<META HTTP-EQUIV=\'refresh\' content="0; URL={}">'
    rows = [
        (1, "http://a.org/x", page.format("http://b.example.com/en/1")), (2, "http://c.org/", go.format("//a.org/x")), (3, "https://WWW.example.com/en/2", ""), (4, "http://example.com/en", None),
        (5, "http://u.net/es/q?x#y", ""), (6, "nothing", ""), (7, None, None), (8, "http://d.org/z", page.format("https://www.example.com/en/3")), (9, "http://e.org/", page.format("http://d.org/z")),
        (10, "http://e.org/", page.format("http://a.example.com/en/7")), (1, "http://a.org/x", page.format("http://b.example.com/en/1")), (11, "http://notexample.com/en/1", ""), (12, "x://y.net", ""),
    ]
    pages = spark.createDataFrame([(*r, "rule", 1, "v") for r in rows], "page_id long, url string, html string, rule string, component int, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert url_filter.filter_urls(pages).count() == len(rows)
    assert [got[k].verdict for k in range(1, 13)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert (got[3].host, got[3].path, got[3].rule) == ("www.example.com", "/en/2", "www.example.com/en/") and got[4].rule == "com/" and got[5].rule == "net/es/"
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and got[11].rule == "com/" and got[12].rule is None
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


#: A page's url and html, and where its aliases lead.
ALIASES = [
    ("http://p.org/a/b", "<meta http-equiv=refresh content=\"0;url='http://b.example.com/en/1'\">", ["http://b.example.com/en/1"]),
    ("http://q.org/", '<link rel="canonical" href="http://c.org/x"><LINK REL=\'nofollow Canonical\' href=/en/2?x=1#y >', ["http://c.org/x", "http://q.org/en/2?x=1"]),
    ("http://r.org/a/b/c?d", '<link href="../x/./y" rel=canonical>', ["http://r.org/a/x/y"]), ("http://s.org", '<link href="z" rel=canonical>', ["http://s.org/z"]), ("http://t.org/a/b", '<link rel=canonical href="?q">', ["http://t.org/a/b?q"]),
    ("http://u.org/a", '<link rel=canonical href="../../..">', ["http://u.org/"]), ("http://v.org/a/b/c", '<link rel=canonical href="..">', ["http://v.org/a/"]), ("http://w.org/", '<link rel=canonical href="/login?next=http://x.org/">', ["http://w.org/login?next=http://x.org/"]),
    ("http://x.org/", "<meta content='5; URL=http:&#x2F;&#47;y.org/?a&amp;b' http-equiv=Refresh>", ["http://y.org/?a&b"]), ("http://y.org/", '<link rel=canonical href="mailto:a@b.c"><meta name=refresh content="0;url=http://no.org/"><link rel=canonicalx data-href="http://no.org/">', []),
    ("nothing", '<link rel=canonical href="/x"><link rel=canonical href="http://n.org/">', ["http://n.org/"]), ("http://z.org/a", '<link rel=canonical href="#top"><link rel=canonical href=" ">', []), ("https://Z.org/", "<link rel=canonical href=//k.org/p>", ["https://k.org/p"]),
]


def test_aliases(spark):
    rows = [(k, *x[:2]) for k, x in enumerate(ALIASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in url_filter.alias_edges(pages).collect():
        got.setdefault(r.src, []).append(r.dst)
    assert {k: sorted(v) for k, v in got.items()} == {u.replace("//Z", "//z") + ("/" if u == "http://s.org" else ""): sorted(v) for u, _, v in ALIASES if v}


def test_aliases_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, *x[:2]) for k, x in enumerate(ALIASES)] + [(50, "http://m.org/1", '<link rel=canonical href="http://n.net/es/q">'), (51, "http://m.org/2", '<link rel=canonical href="1">'), (52, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(llm_queries.oracle_sql()["op3_url_filter"]).fetchall()
    got = [tuple(r) for r in llm_queries.op3_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    verdicts = {r[0]: r[-1] for r in got}
    assert verdicts[0] == "block" and verdicts[50] == verdicts[51] == "block" and verdicts[1] == "allow"


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == len(rows) and got and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block_words=4).collect()))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, *_ in rows)
    assert all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 8 for t, target in by.values())
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * sum(by))
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(docs, block_words=4)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_mixing_draws_decide_the_shards(spark):
    """Each shard's counts follow the multinomial draw, no block is taken more than once before all are, and targets are brute force's."""
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(20, 60)), f"s{k % 5}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks = {seed: mixing.mixed_blocks(docs, block_words=4, shard_blocks=40, seed=seed).collect() for seed in (0, 1)}
    taken = {r.doc_id: (r.taken, r.first_shard) for r in mixing.mix(docs, block_words=4, shard_blocks=40).collect()}
    for k in taken:
        mine = [r for r in blocks[0] if r.doc_id == k]
        assert taken[k] == (sum(r.words for r in mine), min((r.shard for r in mine), default=None))
    slots = {(r.source_no, r.slot): (r.shard, r.block) for r in blocks[0]}
    held = Counter((source, shard) for (source, _), (shard, _) in slots.items())
    shards = 1 + max(shard for _, shard in held)
    quota = Counter(source for source, _ in slots)
    assert shards > 30 and {seed: [*map(str, sorted(map(tuple, b)))] for seed, b in blocks.items()}[0] != [*map(str, sorted(map(tuple, blocks[1])))]
    for source, q in quota.items():
        counts = np.array([held[source, k] for k in range(shards)])
        spread = ((counts - q / shards) ** 2).sum() / (q / shards * (1 - 1 / shards))  # chi-square with shards - 1 degrees of freedom
        assert 0.4 * shards < spread < 1.9 * shards, (source, spread)
    for source in quota:
        times = Counter(b for (s, _), (_, b) in slots.items() if s == source)
        assert max(times.values()) - min(times.get(b, 0) for b in range(max(times) + 1)) <= 1
    sizes, weight = Counter(), {f"s{k}": (3, 1, 2)[k % 3] for k in range(5)}
    for _, t, s in rows:
        sizes[s] += len(t.split())
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            want[s] = 2 * sizes[s]
        free -= {*over}
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    got = {rows[r.doc_id][2]: r.target for r in mixing.mix(docs, block_words=4).collect()}
    assert got == pytest.approx(want)


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_token_counts(docs, rows, nothing):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows]
    assert got == Counter((*w, w[2] > 4096) for w in want)
    assert token_counts.token_counts(nothing).count() == 0
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab  \n\t▁.é日😀<s>") for _ in range(rng.randrange(40))) for _ in range(300)]
    for chunk in (5, 64):
        machine = token_counts.CountTransducer(library, 50, chunk)
        assert [machine.count(t) for t in odd] == [len(library.encode(t)) for t in odd]


def test_packing(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, 512).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) - 512 * ((len(ids) - 1) // 512)
        cuts = [0, *range(first, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 512
    assert packing.best_fit_packing(nothing).count() == 0


def test_packing_plan_uses_few_bins():
    rng = random.Random(2)
    for _ in range(50):
        c = rng.choice([30, 100, 2048])
        h = {rng.randint(1, c // 2): rng.randint(1, 50) for _ in range(30)}
        bins = {f + (r - a) // k for n, a, b, k, f, _ in packing.plan(h, c) for r in range(a, b)}
        assert len(bins) <= 1.25 * sum(n * k for n, k in h.items()) / c + 2


def test_quality(docs, labels, nothing, rows):
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert quality.classify_quality(nothing, labels).count() == 0
    assert all(r.kept for r in quality.classify_quality(docs, labels.limit(0)).collect())
    assert quality.reject_low_quality(docs, labels).columns == docs.columns


def test_quality_rates_leave_out_the_document(spark):
    """Rates by brute force from the evidence; a document's own label never enters its own score; ties and repeats score alike."""
    rng = random.Random(14)
    rows = [(k, prose(rng, rng.randrange(5, 60)), "en" if k % 3 else None, f"s{k % 4}") for k in range(80)] + [(200, "same", "en", "s1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    label = {k: int(rng.random() < 0.8) for k in range(0, 80, 2)}
    frame = lambda x: spark.createDataFrame([*x.items()], "doc_id long, quality int")
    got = quality.classify_quality(docs, frame(label)).collect()
    assert len({tuple(r) for r in got if r.doc_id == 200}) == 1
    of = {r[0]: (r[3], r[2]) for r in rows}
    good = [(of[r.doc_id], label.get(r.doc_id, r.evidence), r) for r in got]
    base = sum(g for _, g, _ in good) / len(good)
    strengths = set()
    for (host, path), g, r in good:
        hosts = [x for (h, _), x, _ in good if h == host]
        paths = [x for hp, x, _ in good if hp == (host, path)]
        left_out = sum(hosts) - g, len(hosts) - 1, sum(paths) - g, len(paths) - 1
        # rate = (good + m * above) / (n + m), so m = (good - n * rate) / (rate - above), the same for all
        for n, total, rate, above in ((left_out[1], left_out[0], r.host_rate, base), (left_out[3], left_out[2], r.path_rate, r.host_rate)):
            if abs(rate - above) > 1e-3:
                strengths.add((above == base, round((total - n * rate) / (rate - above), 2)))
    assert all(quality.STRENGTHS[0] - 1 <= m <= quality.STRENGTHS[1] * 1.01 for _, m in strengths)
    assert all(max(m for k, m in strengths if k == kind) <= 1.01 * min(m for k, m in strengths if k == kind) + 0.1 for kind in {k for k, _ in strengths})


def test_quality_learns(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 60).upper() + "!!" * 20 if k % 5 == 0 else prose(rng, 60), "en", f"s{k % 4}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(200)], "doc_id long, quality int")
    wrong = [r for r in quality.classify_quality(docs, labels).collect() if r.doc_id >= 200 and r.kept != (r.doc_id % 5 > 0)]
    assert not wrong


def test_toxicity(docs, labels, nothing, rows):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def toxic_rows(n, seed=6):
    rng = random.Random(seed)
    make = lambda bad: " ".join("fie" + rng.choice("abcdefgh") * rng.randrange(1, 4) if bad and rng.random() < 0.05 else w for w in prose(rng, 200).split())
    y = [int(k % 6 == 0) for k in range(n)]
    return [(k, make(b)) for k, b in enumerate(y)], [*enumerate(y)]


def test_toxicity_held_out_accuracy(spark):
    texts, y = toxic_rows(500)
    texts += [(1000, "fine words"), (1001, "you fieaa fieb"), (1002, "")] + [(1003, texts[0][1] + " fine")] * 3
    got = toxicity.score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")).collect()
    assert len(got) == len(texts)
    label, score = dict(y), {r.doc_id: r.score for r in got}
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95 and score[1000] < 0.5 and score[1001] > 0.7 and score[1002] < 0.5
    assert len({r.score for r in got if r.doc_id == 1003}) == 1
    # as many toxic as ordinary rows: evidence must not vanish
    even = [(k, t) for k, t in enumerate(z for w in range(3) for z in (x for (i, x), (_, b) in zip(*toxic_rows(240, w), strict=True) if b or i % 5 == 1))]
    y = [(k, int("fie" in t)) for k, t in even]
    got = toxicity.score_toxicity(spark.createDataFrame(even, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted == dict(y)[r.doc_id] for r in got if r.held_out]) > 0.9


def test_toxicity_counts_and_discounts(spark):
    """Continuation counts, shares and normalisation against plain code."""
    texts, y = toxic_rows(60)
    rows = [(t, b, k % 2) for (_, t), (k, b) in zip(texts, y, strict=True)] + [(texts[0][1], 1, 0)] * 5  # repeats change no count
    found = toxicity._expressions(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    want = Counter()
    for w, c in [(w, c) for w, _, c in {(w, v, c) for t, c, _ in rows for v, w in zip(["", *t.split()], t.split())}]:
        want.update([(w, False, c), ("", True, c), *((w[:k], True, c) for k in toxicity.BEGINNINGS if len(w) >= k)])
    for r in found.itertuples():
        assert (r.n0, r.n1) == (want[r.text, r.begins, 0], want[r.text, r.begins, 1])
    assert {(t, b) for t, b, _ in want if want[t, b, 0] + want[t, b, 1] > 2} == {*zip(found.text, found.begins, strict=True)}
    n, parent, depth = np.array([[90.0, 10], [50, 8], [40, 0]]), np.array([0, 0, 0]), np.array([0, 1, 1])
    s = toxicity.shares(n, parent, depth)
    top = 10.5 / 101
    assert 8 - 58 * top < 2 * (1 + (58 * top) ** 0.5)  # within the discount
    assert s[0] == pytest.approx(top) and s[1] == pytest.approx(top)
    models = toxicity.ClassModels.fit(n, parent, depth)
    assert np.array([2, 58, 40]) / 100 @ np.exp(models.against.astype(float)) == pytest.approx([1, 1], abs=1e-5)


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8)).astype("f4")
    x[600:640] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (100, x[100].tolist())]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got: dict[int, list] = {}
    for r in neighbours.nearest_neighbours(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    found = wanted = 0
    ids, vecs = np.r_[np.arange(700), 100], np.r_[x, x[100:101]].astype(float)
    for q, hits in got.items():
        d = np.sqrt(((vecs - x[q].astype(float)) ** 2).sum(1))
        own = int(np.flatnonzero(ids == q)[0])
        order = [k for k in np.lexsort((ids, d)) if k != own][:10]
        hits.sort()
        assert [r for r, _, _ in hits] == list(range(1, 11))
        for _, v, s in hits:
            assert abs(s - d[int(np.flatnonzero(ids == v)[0])]) < 1e-12
        found += len({v for _, v, _ in hits} & {int(ids[k]) for k in order})
        wanted += len({int(ids[k]) for k in order})
    assert found >= 0.9 * wanted
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    few = neighbours.nearest_neighbours(table.where("vec_id < 4")).collect()
    assert len(few) == 3


def test_nn_descent_beyond_one_block(spark):
    """With blocks far smaller than the table the descent does the work; no node is its own neighbour."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>")
    nodes = rows.mapInArrow(neighbours._packed, "vec_id long, vec binary").withColumnRenamed("vec_id", "node")
    recall = {}
    for rounds in (0, neighbours.ROUNDS):
        got: dict[int, set] = {}
        for r in neighbours.build_graph(nodes, k=20, rounds=rounds, orders=2, block=32).collect():
            assert r.node != r.nbr
            got.setdefault(r.node, set()).add(r.nbr)
        true = {k: set(np.argsort(((x - x[k]) ** 2).sum(1))[1:11].tolist()) for k in range(0, 1500, 15)}
        recall[rounds] = np.mean([len(got.get(k, set()) & t) / 10 for k, t in true.items()])
    assert recall[0] < 0.6 and recall[neighbours.ROUNDS] >= 0.9, recall


def test_lm_scores(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 40)
    got = lm_scoring.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update([*lowered(t).encode().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = [*lowered(t).encode().split(), None]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(float(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(nothing).count() == 0


def test_every_block_moves_the_network(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(lm_scoring, "STEPS", 8)
    monkeypatch.setattr(lm_scoring, "MERGED", 3)
    rng = np.random.default_rng(2)
    xs = [np.concatenate([np.r_[1, rng.integers(3 + 50 * b, 53 + 50 * b, 30)] for _ in range(20)]) for b in range(6)]  # no id is in two blocks
    size = lm_scoring._subwords(None).size
    counts = sum(np.bincount(x, minlength=size) for x in xs).astype(float)
    counts[[1, 2]] = 0, 120
    m = np.zeros((size, 2 * lm_scoring.FREQUENT), "f4")
    for x in xs:
        keys, n = lm_scoring._pairs(x, size, lm_scoring._frequent(counts))
        m.ravel()[keys] += n
    at = np.flatnonzero(counts)
    at = at[at > 2]
    begins = np.isin(np.arange(size), at[::2])
    kinds = lm_scoring.IDS, lm_scoring.BEGINS
    ids = pd.DataFrame([(kinds[0], i, int(counts[i])) for i in at] + [(kinds[1], i, 1) for i in at[::2]], columns=["kind", "h", "total"])
    rows = []
    for b, x in enumerate(xs):  # a word is an id
        words, w = np.unique(x[x > 1], return_inverse=True)
        pack = lm_scoring.Pack.of([*w.reshape(20, 30).astype(np.int32)], lm_scoring.Pieces(np.ones(len(words)), words.astype(np.int32)))
        assert (pack.training(np.ones(20, bool)) == x).all() and len(pack.training(np.arange(20) < 2)) == 62
        rows.append((b, 1, np.ones(20, bool).tobytes(), *pack.row()))
    texts = spark.createDataFrame(rows, f"block int, part int, learn binary, {lm_scoring.Pack.SCHEMA}").repartition(3)
    model = lm_scoring.AttentionModel.from_bytes(lm_scoring._fit(texts, ids, 120, None)["data"])
    before = lm_scoring.initial(m, counts, begins)
    moved = (model.e != before.e).any(axis=1)
    assert moved[at].all() and not moved[3 + 300 :].any() and (model.cls == before.cls).all()


def test_mixture_weight():
    p, q = np.array([0.8, 0.2]), np.array([0.1, 0.9])
    n = 1000 * (0.3 * p + 0.7 * q)
    best = min(np.linspace(0.02, 0.98, 97), key=lambda a: -(n * np.log(a * p + (1 - a) * q)).sum())
    assert lm_scoring._mixture(np.log(p / q), n) == pytest.approx(best, abs=0.02) and lm_scoring._mixture(np.zeros(0), np.zeros(0)) == 0.5


def test_windows_score_each_id_once():
    sizes = np.array([1, 15, 16, 17, 100])
    starts = np.cumsum(sizes) - sizes
    at, own = lm_scoring._windows(np.zeros(sizes.sum()), starts, sizes)
    seen = at[:, lm_scoring.HALF :][own]
    assert sorted(seen.tolist()) == list(range(sizes.sum()))


def small_words():
    """(subwords, words among which are beginnings of others and one that its ids do not spell, their pieces)."""
    subwords, rng = lm_scoring._subwords(None), random.Random(31)
    words = sorted({w[:k].encode() for w in prose(rng, 300).split() for k in (1, 2, 3, len(w))} | {b"walk", b"walked", b"walking", "\u2581x".encode(), "\u00e9t\u00e9".encode(), "\U0001f9ff".encode()})
    return subwords, words, subwords.pieces(words)


def test_words_and_the_end_have_mass_one_at_most():
    """In random contexts, over many words: the network's, and its mixture with any share."""
    subwords, words, pieces = small_words()
    assert [w for w, n in zip(words, pieces.spelled, strict=True) if n] == ["\u2581x".encode()]
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, len(words), 40).astype(np.int32) for _ in range(60)]
    pack = lm_scoring.Pack.of(texts, pieces)
    ids = [y[y != 2] for y in (pack.stream(i, i + 1)[1] for i in range(60))]
    counts = np.bincount(np.concatenate(ids), minlength=subwords.size).astype(float)
    counts[2] = 60
    m = np.zeros((subwords.size, 2 * lm_scoring.FREQUENT), "f4")
    keys, n = lm_scoring._pairs(pack.training(np.ones(60, bool)), subwords.size, lm_scoring._frequent(counts))
    m.ravel()[keys] = n
    begins = np.bincount(pieces.flat[pieces.begin], minlength=subwords.size) > 0
    model = lm_scoring.initial(m, counts, begins, opening=subwords.opening)
    lm_scoring.descend(model, pack.training(np.ones(60, bool)), 60)
    model = lm_scoring.AttentionModel.from_bytes(model.to_bytes())
    for size in (0, 1, 7):
        before = rng.integers(0, len(words), size).astype(np.int32)
        each = lm_scoring.Pack.of([np.append(before, np.int32(k)) for k in range(len(words))] + [before], pieces)
        p, w = lm_scoring._text_log_probs(model, each, 0, len(words) + 1)
        at = np.flatnonzero(w < 0)
        of_words, of_end = p[at[:-1] - 1], p[at[-1]]
        total = np.exp(of_words).sum() + np.exp(of_end)
        assert 0.1 < total <= 1 + 1e-4
        assert of_words[words.index("\u2581x".encode())] == pytest.approx(np.log(lm_scoring.SPELLED) - 5 * np.log(257))


def test_openings_add_up():
    """The probability that the next id opens a token is the sum over the ids that do."""
    rng = np.random.default_rng(8)
    counts = np.r_[0, 0, 5, rng.integers(1, 50, 200)].astype(float)
    opening = np.arange(len(counts)) % 3 == 2
    x = np.r_[1, rng.integers(3, len(counts), 40)]
    m = np.zeros((len(counts), 2 * lm_scoring.FREQUENT), "f4")
    keys, n = lm_scoring._pairs(x, len(counts), lm_scoring._frequent(counts))
    m.ravel()[keys] = n
    model = lm_scoring.initial(m, counts, opening, opening=opening)
    at, z = np.array([0]), np.array([len(x)])
    total = sum(np.exp(model.log_probs(x, np.full(len(x), y), at, z)) for y in np.flatnonzero(opening))
    assert np.allclose(total, np.exp(model.log_probs_and_openings(x, x, at, z)[1]), atol=1e-4)


def test_lm_scores_without_training_texts(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    got = lm_scoring.score_texts(spark.createDataFrame([(k, "some words here") for k in held], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) and r.score < 0 for r in got)


def test_samples_are_bounded_where_an_id_repeats(spark):
    """An id of 3,000 rows counts once in the samples of quality and toxicity."""
    rng = random.Random(12)
    rows = [(k, prose(rng, 40)) for k in range(60)] + [(0, f"{prose(rng, 10)} {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, good int").withColumn("good", F.col("good").cast("double"))
    collected = []
    fit = quality.fit_logistic
    quality.fit_logistic = lambda x, y, *a: (collected.append(len(x)), fit(x, y, *a))[1]
    try:
        quality._model(docs, labels, 50)
    finally:
        quality.fit_logistic = fit
    assert collected == [50]
    seen = []
    expressions = toxicity._expressions
    toxicity._expressions = lambda sample: (seen.append(sample.count()), expressions(sample))[1]
    try:
        toxicity._fit(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"), 20)
    finally:
        toxicity._expressions = expressions
    assert seen == [40]


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(0)
    counts = np.r_[0, 0, 5, rng.integers(1, 50, 400)].astype(float)
    begins = np.arange(len(counts)) % 2 == 0
    ids = [rng.integers(3, len(counts), 60) for _ in range(30)]
    model = lm_scoring.train(ids, counts, begins, steps=5)
    x = np.r_[1, ids[0]]
    at, z = np.array([0]), np.array([len(x)])
    total = sum(np.exp(model.log_probs(x, np.full(len(x), y), at, z)) for y in range(2, len(counts)))
    assert np.allclose(total, 1, atol=1e-3)
    changed = x.copy()
    changed[40:] = 7
    y = np.r_[ids[0], 2]
    assert np.allclose(model.log_probs(x, y, at, z)[:40], model.log_probs(changed, y, at, z)[:40], atol=1e-5)


def test_words_are_sent_in_lists(spark, monkeypatch, tmp_path):
    """A block's words go to each of their owners in one list, not in a row each."""
    monkeypatch.setattr(lm_scoring, "STEPS", 2)
    rng = np.random.default_rng(6)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20_000)])
    texts = [" ".join(words[rng.zipf(1.2, 400) % 20_000]) for _ in range(300)]
    monkeypatch.setattr("satchel.llm.common.scratch_root", lambda _: str(tmp_path))
    assert lm_scoring.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 300
    rows = sum(spark.read.parquet(str(p)).where("kind < 2").count() for p in tmp_path.glob("packs-*"))  # the kinds of words
    assert 0 < rows <= 2 * 8 * 8, rows  # scored and tuned packs, owners and blocks


def test_lists_of_numbers_and_words_of_texts():
    rng = np.random.default_rng(7)
    for x in (np.zeros(0, np.int64), np.zeros(5, np.int32), rng.integers(0, 70_000, 999).astype(np.int32), rng.integers(0, 2**40, 99)):
        kind = np.int64 if x.dtype == np.int64 else np.int32
        assert (lm_scoring._unsqueezed(lm_scoring._squeezed(x), kind) == x).all()
    texts = ["", " ", "  A b\x1c 　cÉ\t\n\x0b\x0c\rb A ", "x"]
    b = lm_scoring.Block(texts)
    want = [t.encode().lower().split() for t in texts]
    b.order(b.hashes() % np.uint64(3))
    assert b.sizes.tolist() == [len(w) for w in want] and [b.words[i] for i in b.w] == [w for t in want for w in t]
    words, subwords = ["café".encode(), "▁x".encode(), "\U0001f600z".encode(), b"the"], lm_scoring._subwords(None)
    whole = lambda i: subwords.MARK + words[i] == b"".join(subwords._bytes[k - subwords.FIRST] for k in p.flat[p.begin[i] : p.begin[i] + p.length[i]])
    p = subwords.pieces(words)
    assert p.spelled.tolist() == [0 if subwords.MARK not in w and whole(i) else len(w) for i, w in enumerate(words)]


def test_each_round_reads_its_own_windows_only(spark, monkeypatch, tmp_path):
    """Windows are dealt once, and a round reads no texts; all rounds together have each next id once."""
    monkeypatch.setattr(lm_scoring, "STEPS", 3)
    monkeypatch.setattr("satchel.llm.common.scratch_root", lambda _: str(tmp_path))
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, prose(rng, 80)) for k in range(200)], "doc_id long, text string")
    assert lm_scoring.score_texts(docs).count() == 200
    dealt = [r for p in tmp_path.glob("windows-*") for r in spark.read.parquet(str(p)).collect()]
    packs = [r for p in tmp_path.glob("packs-*") for r in spark.read.parquet(str(p)).where(f"kind = {lm_scoring.SCORED}").collect()]
    many = 0
    for r in packs:
        x = lm_scoring.Pack.read(*(getattr(r, c) for c in lm_scoring.Pack.COLUMNS)).training(np.frombuffer(r.learn, bool))
        got = [lm_scoring._unsqueezed(d.windows).reshape(-1, 17) for d in sorted(dealt, key=lambda d: d.share) if (d.block, d.part) == (r.block, r.part)]
        y = np.append(x[1:], 1)
        want = Counter(zip(x.tolist(), np.where(y == 1, 2, y).tolist(), strict=True))
        assert len(got) == lm_scoring.ROUNDS and Counter((a, b) for g in got for w in g.tolist() for a, b in zip(w, w[1:]) if b) == want
        many += len(x)
    assert many > 10_000


def test_gradients_are_those_of_the_loss():
    """The first step moves each weight against the slope of the mean loss of the next ids."""
    rng = np.random.default_rng(3)
    counts = np.r_[0, 0, 5, rng.integers(1, 50, 80)].astype(float)
    x = np.concatenate([np.r_[1, rng.integers(3, len(counts), n)] for n in (40, 3, 15)])
    m = np.zeros((len(counts), 2 * lm_scoring.FREQUENT), "f4")
    keys, n = lm_scoring._pairs(x, len(counts), lm_scoring._frequent(counts))
    m.ravel()[keys] = n
    windows = lm_scoring.shares(x, 1)[0]

    def loss(model):
        total = 0.0
        for w in windows:
            w = w.astype(int)[: np.flatnonzero(w[1:])[-1] + 2]
            e = model.e.astype(float)[w[:-1]]
            lag = np.subtract.outer(np.arange(len(e)), np.arange(len(e)))
            a = np.where(lag >= 0, (e @ model.wq) @ (e @ model.wk).T / 4 + model.distance[np.maximum(lag, 0)], -np.inf)
            a = np.exp(a) / np.exp(a).sum(1, keepdims=True)
            z = (a @ e @ model.wv + e @ model.wr) @ model.wc + model.bias
            total += (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), model.cls[w[1:]]]).sum()
        return total / (windows[:, 1:] > 0).sum()

    fresh = lambda: lm_scoring.initial(m, counts, np.arange(len(counts)) % 2 == 0)
    before, after = fresh(), fresh()
    lm_scoring.take_steps(after, windows, 1)
    for name, at in (("e", (5, 3)), ("wq", (2, 7)), ("wk", (9, 1)), ("wv", (4, 4)), ("wr", (0, 15)), ("distance", (2,)), ("wc", (6, 20)), ("bias", (30,))):
        up, down = fresh(), fresh()
        getattr(up, name)[at] += 1e-2
        getattr(down, name)[at] -= 1e-2
        slope = loss(up) - loss(down)
        moved = getattr(after, name)[at] - getattr(before, name)[at]
        assert abs(slope) < 1e-7 or np.sign(moved) == -np.sign(slope), (name, slope, moved)
