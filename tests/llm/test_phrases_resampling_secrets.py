"""Collocations, importance resampling and secrets against brute force, and on nulls, repeats, ties, long texts and empty tables."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from satchel.llm import collocations, resampling, secrets

WORDS = "new york city hall red green blue Éa ß 日本 x1 x2 the of".split()
#: Columns whose names are also used inside the operators.
SCHEMA = "doc_id long, text string, lang string, phrase string, f long, a int, chunk int, part string, place int, score double, rank int, words string, sums int, spans int"
MORE = ("p", 1, 2, 3, "q", 4, 0.5, 5, "w", 6, 7)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, *MORE) for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    ends = [" ", " ", " ", " ", ", ", ". ", "\n", "\t", "! ", "  "]
    say = lambda n: "".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))
    out = [(k, say(rng.randrange(60)), rng.choice(["en", "en", None, "und", "de", ""])) for k in range(150)]
    out += [(500 + k, "New York City" + " hall" * (k % 2), "en") for k in range(30)]  # new york city holds new york
    out += [(600, None, "en"), (601, "", None), (602, " \t\n.,", "fr"), (603, say(20000), "en"), (None, say(30), "de"), (603, "same words here", None)]
    out += [(700, "one copy of many", "es")] * 40
    return out


def brute_collocations(rows, longest, least, top, share):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda s, b: any(b[i : i + len(s)] == s for i in range(len(b) - len(s) + 1))
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(b) > len(p) and 100 * c >= share * a and inside(p, b) for (x, b), c in found.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0].encode(), -x[6], -x[2], x[1].encode()))
    seen = Counter()
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= top:
            yield x[0], seen[x[0]], *x[1:]


@pytest.mark.parametrize(("longest", "least", "top", "share"), [(3, 10, 2000, 50), (2, 3, 7, 50), (4, 2, 40, 80)])
def test_collocations(spark, rows, longest, least, top, share):
    got = collocations.collocations(make(spark, rows), longest, least, top, share).collect()
    assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, longest, least, top, share))
    assert got


def test_collocations_of_nothing(spark, rows):
    columns = "lang rank phrase a l r n score".split()
    for few in ([], [(1, None, None)], rows[:3]):
        got = collocations.collocations(make(spark, few), least=1000)
        assert got.columns == columns and got.count() == 0


def test_phrases_across_slices(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "bb", "cc", "."]) for _ in range(3000)).encode()
    whole = Counter(dict(zip(*next(collocations._phrases(text.split(), 3, b"en", None)), strict=True)))
    monkeypatch.setattr(collocations, "CHUNK", 50)
    found, carried, slices = Counter(), [], list(collocations._slices(text))
    for tokens in slices:
        tokens = carried + tokens
        for phrases, counts in collocations._phrases(tokens, 3, b"en", None):
            found.update(dict(zip(phrases, counts, strict=True)))
        carried = tokens[-2:]
    assert len(slices) > 100 and sum(slices, []) == text.split() and found == whole


def test_only_phrases_of_frequent_parts_are_emitted():
    """A phrase leaves a pass only when both shorter ones have their bit; a full bit set leaves all."""
    tokens = b"a b c . a b d . b c".split()
    bits = np.zeros(1 << 12, dtype=np.uint8)
    for phrase in (b"a b", b"b c"):
        words = phrase.split()
        crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
        h = int(collocations._mixed(np.arange(2), np.array([0]), crc, 2, b"en")[0]) & (bits.size * 8 - 1)
        bits[h >> 3] |= 1 << (h & 7)
    assert [p for p, _ in collocations._phrases(tokens, 3, b"en", bits)] == [[b"a b c"]]
    assert sorted(next(collocations._phrases(tokens, 3, b"en", ~np.zeros(8, dtype=np.uint8)))[0]) == [b"a b c", b"a b d"]
    assert not list(collocations._phrases(tokens, 3, b"de", bits))


def test_bit_set_holds_every_frequent_phrase(spark, rows):
    levels = collocations.frequent_phrases(make(spark, rows), 2, 3)
    for k, level in ((1, levels[0].where("phrase <> ''")), (2, levels[1])):
        bits = collocations._bit_set(level, k).value
        assert bits.size * 8 <= collocations.MOST_BITS
        for r in level.collect():
            words = r.phrase.encode().split(b" ")
            h = int(collocations._mixed(np.arange(k), np.array([0]), np.array([zlib.crc32(w) for w in words], dtype=np.uint64), k, r.lang.encode())[0]) & (bits.size * 8 - 1)
            assert bits[h >> 3] >> (h & 7) & 1


def brute_resample(rows, target, percent, least_words, seed, longest, buckets):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in features(text)[1]) for texts in ([r[1] for r in rows], target))
    b, all_s, all_t = buckets, sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + b) / ((s[k] + 1) * (all_t + b)))) for k in range(b)]
    out = []
    for doc_id, text, _ in rows:
        n, x = features(text)
        weight = sum(gain[bucket(y)] for y in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((-x[3], -1 if x[0] is None else x[0], k) for k, x in enumerate(out) if x[4] >= least_words)
    rank = {k: place for place, (_, _, k) in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*x[:4], rank.get(k)) for k, x in enumerate(out)]


def by_row(found):
    return sorted(found, key=lambda r: tuple(-(10**9) if v is None else v for v in r))


@pytest.mark.parametrize(("percent", "least_words", "seed", "longest", "buckets"), [(25, 20, 7, 2, 10000), (60, 0, 1, 3, 97), (100, 1, 2, 1, 500)])
def test_resampling(spark, rows, percent, least_words, seed, longest, buckets):
    target = [None, "", *("red green new york " * k for k in range(9)), "日本 éa ß"]
    told = spark.createDataFrame([(k, t, 3) for k, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in resampling.resample(make(spark, rows), told, percent, least_words, seed, longest, buckets).collect()]
    want = brute_resample(rows, target, percent, least_words, seed, longest, buckets)
    # equal rows may change places
    assert by_row(r[:4] for r in got) == by_row(r[:4] for r in want)
    assert by_row(got) == by_row(want)


def test_resampling_of_nothing(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    columns = "doc_id n_features weight score rank".split()
    got = resampling.resample(make(spark, []), none)
    assert got.columns == columns and got.count() == 0
    got = [tuple(r) for r in resampling.resample(make(spark, rows[:40]), none).collect()]
    assert by_row(got) == by_row(brute_resample(rows[:40], [], 25, 20, 7, 2, 10000))


def test_each_distinct_feature_is_hashed_once(monkeypatch):
    hashed = Counter()
    monkeypatch.setattr(resampling, "zlib", type("Z", (), {"crc32": staticmethod(lambda x: hashed.update([x]) or zlib.crc32(x))}))
    held = resampling._Dictionary(100)
    first = held.add([b"a", b"a b", b"c"], np.array([3, 1, 2]))
    assert (held.add([b"c", b"a"], np.array([5, 7])) == first[[2, 0]]).all()
    sums = dict(zip(*held.sums(), strict=True))
    assert set(hashed.values()) == {1} and sum(sums.values()) == 18 and sums[zlib.crc32(b"a") % 100] == 10


def test_a_chunk_sends_each_feature_once():
    found = resampling.Features(*resampling.numbered([b"a b a b", b"", b"a b c"]), 2)
    assert dict(zip(found.strings(), found.counts, strict=True)) == {b"a": 3, b"b": 3, b"c": 1, b"a b": 3, b"b a": 1, b"b c": 1}
    assert found.documents == 3 and list(found.n_words) == [4, 0, 3]
    assert sorted(np.concatenate([at for _, at in found.by_part(4)])) == list(range(6))


def brute_spans(text, allow):
    """Base spans by hand-made scanning, windows of high entropy counted anew each."""
    text, base = text or "", []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            base.append((m.start(), 0, "assign", m.end()))
    for place, (kind, begin, more, least) in enumerate((("access", "AKIA", string.ascii_uppercase + string.digits, 20), ("hex", "", "0123456789abcdef", 24)), 1):
        at = 0
        while at < len(text):
            end = at + len(begin)
            while text.startswith(begin, at) and end < len(text) and text[end] in more:
                end += 1
            if not text.startswith(begin, at) or end == at + len(begin):
                at += 1
                continue
            if end - at >= least:
                base.append((at, place, kind, end))
            at = end
    base.sort()
    entropy = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if any(re.fullmatch(p, m[0], re.DOTALL) for p in allow):
            continue
        here = []
        for place, (kind, (members, width, bits)) in enumerate(secrets.CLASSES.items(), 3):
            hit = [i for i in range(m.start(), m.end() - width + 1) if set(text[i : i + width]) <= members and entropy(text[i : i + width]) >= bits - 1e-9]
            covered = sorted({j for i in hit for j in range(i, i + width)})
            # windows that only touch are one stretch too
            cuts = [0, *(k for k in range(1, len(covered)) if covered[k] != covered[k - 1] + 1), len(covered)]
            here += [(covered[a], place, kind, covered[b - 1] + 1) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        here = [s for s in here if not any(re.fullmatch(p, text[s[0] : s[3]], re.DOTALL) for p in allow)]
        found += [s for s in here if not any(o != s and o[0] <= s[0] and s[3] <= o[3] and ((o[0], o[3]) != (s[0], s[3]) or o[1] < s[1]) for o in here)]
    return base, sorted(base + [s for s in found if not any(b[0] <= s[0] and s[3] <= b[3] for b in base)])


def said(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(11)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", "0123456789", "abc", string.ascii_lowercase]
    run = lambda: "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(2, 60)))
    parts = ["password=", "TOKEN : '", 'api_key="', "apikey:", "Secret==", "ſecret=abcdefgh", "passwd= ", "AKIA", "é日", " ", " ", ", ", ".", "-", "_", "/", "example", "\n"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else run() for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "password=short", "password=", "token=tok", "AKIA", "AKIAAKIAAKIA1234567", "AKIA" + "A" * 16, "0" * 23, "0" * 24, "token: 'abcdef' token: 'abcdef'"]
    texts += ["f47ac10b-58cc-4372-a567-0e02b2c3d479", "deadbeef" * 6, "Donaudampfschifffahrtsgesellschaft", "some-long-name/of-a-file/in_a_path", "日" * 9 + "kJ8s+Qz1/Xw93LmNp0aRt5vYbC7d" + "日"]
    return texts + [("word " * 3000 + run() + " ") * 5]


def test_secrets(spark, secret_texts):
    rows = [(k % 390, t, "en") for k, t in enumerate(secret_texts)] + [(None, "token=abcdefg", None), (5, secret_texts[5], "en")]
    got = secrets.scan_secrets(make(spark, rows))
    assert got.columns == "doc_id n_assign n_access n_hex base_sha256 spans".split()
    want = []
    for i, text, _ in rows:
        base, spans = brute_spans(text, secrets.ALLOW)
        kinds = Counter(s[2] for s in base)
        want.append((i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
    assert by_id(map(tuple, got.collect())) == by_id(want)
    assert sum("entropy_hex" in w[5] for w in want) > 5 and sum("entropy_base64" in w[5] for w in want) > 5
    assert secrets.scan_secrets(make(spark, [])).count() == 0
    assert secrets.spans_table(got).count() == sum(len(w[5].split(",")) for w in want if w[5])


def by_id(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_secrets_are_found_and_ordinary_strings_are_not():
    rng, allow = random.Random(3), re.compile("|".join(f"(?:{p})" for p in secrets.ALLOW), re.DOTALL)
    for alphabet, n in ((string.ascii_letters + string.digits + "+/", 40), ("0123456789ABCDEF", 40)):
        keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(200)]
        assert sum(bool(secrets.entropy_spans(f"see {k} here", allow)) for k in keys) >= 195
    plain = ["Rindfleischetikettierungsueberwachungsaufgabenuebertragungsgesetz", "getUserAccountSettingsFromDatabase2", "2024-01-31_report-of-the-second-quarter", "http://example.com/some/long/path/to/nowhere", "========================================", "01234567890123456789", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijkl"]
    assert not any(secrets.entropy_spans(p, allow) for p in plain)


def test_a_window_moves_by_two_terms():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdef-", k=3000))
    got = list(secrets.dense_stretches(text, frozenset("abcdef"), 8, 2.2))
    entropy = lambda w: -sum(c / 8 * math.log2(c / 8) for c in Counter(w).values())
    covered = {j for i in range(len(text) - 7) if "-" not in text[i : i + 8] and entropy(text[i : i + 8]) >= 2.2 for j in range(i, i + 8)}
    assert covered == {j for a, b in got for j in range(a, b)} and all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))
