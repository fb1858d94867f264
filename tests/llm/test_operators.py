"""The training-data operators against brute force, and their corner cases."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import bitmap, curriculum, decontaminate, exact_dedup, gru_langid, license_scan, rans, rff_quality, simhash, substring_dedup, token_counts, token_files, tokens, words
from dossier.llm.queries import tokenizer_path

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = [(90001, None), (90002, ""), (90003, "  \t\n"), (90004, "one"), (90005, "a b c " * 40), (90006, "a b c " * 40), (90007, "x " * 100), (90008, "é ñ " * 30), (90009, "word " * 30000)]


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns carry names that operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_text", "_id", "n", "key", "score", "fp", "size", "words")})
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_word_helpers():
    texts = ["a bb  c", "", None, " x\ty\n", "é z"]
    data, at = words.utf8(pa.array(texts))
    starts, ends, first = words.spans(data, at)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bb", "c", "x", "y", "é", "z"]
    assert first.tolist() == [0, 3, 3, 3, 5, 7]
    h = words.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == 7
    w = np.arange(1, 60, dtype=np.uint64)
    for n in (1, 2, 3, 18, 35):
        r = words.rolling(w, n, 12345677)
        assert len(r) == len(w) - n + 1 and len(set(r.tolist())) == len(r)
        again = words.rolling(np.concatenate([w[5:], w]), n, 12345677)
        assert again[len(w) - 5] == r[0] and again[0] == r[5]
    x = np.array([5, 3, 9, 1, 7, 2])
    for n in (1, 2, 3, 5, 6):
        assert words.sliding(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


def test_decontamination(spark, docs, rows):
    items = [(1, "The quick brown fox jumps over the lazy dog today again"), (2, "short ITEM here"), (3, ""), (4, None), (None, "nothing like this at all in any of these texts ever"), (10, "short item here")]
    extra = [(80001, "xx the QUICK, brown fox jumps-over the lazy dog TODAY yy short item here"), (80002, "short item"), (80003, "short item here short item here")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(df, bench).collect()}
    assert len(got) == len(rows) + 3
    assert (got[80001].n_words, got[80001].n_hit, got[80001].items) == (15, 13, ["1", "10", "2"])
    assert got[80002].n_hit == 0 and (got[80003].n_hit, got[80003].n_items) == (6, 2)
    assert got[90001].n_words == 0 and not got[90001].contaminated
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench).collect()}
    assert set(kept) == {i for i, r in got.items() if not r.contaminated}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, "spans").collect()}
    assert spans[80001] == "xx yy " and spans[80003] == "" and spans[80002] == "short item" and spans[90001] is None and len(spans) == len(got)


def test_decontamination_by_several_hash_sets(spark, docs, rows, monkeypatch):
    df = docs.union(docs.where("doc_id > 90004").limit(3))
    bench = spark.createDataFrame([(1, "short item here"), (2, "a b c a b c a b c a b c"), (3, dict(rows)[rows[0][0]]), (4, "x x"), (5, "é")], "item_id long, text string")
    find = lambda: sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontaminate.find_contamination(df, bench).collect())
    want = find()
    monkeypatch.setattr(decontaminate, "OPENINGS", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert find() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (90005, 120, 120, ["2"]) in want and len(want) == len(rows) + 3


def test_simhash(docs, rows, monkeypatch):
    prints = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    for direct in (24, 1):
        monkeypatch.setattr(simhash, "DIRECT", direct)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_links_of_a_dense_bucket(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    vals = {base}
    for _ in range(300):
        v = base
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            v ^= 1 << int(b)
        vals.add(v)
    vals = sorted(vals)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in vals]
    root = list(range(len(vals)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(vals)):
        for j in range(i):
            if (vals[i] ^ vals[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    monkeypatch.setattr(simhash, "DIRECT", 8)
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    at = {v: i for i, v in enumerate(signed)}
    mine = list(range(len(vals)))

    def find2(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for r in got:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2
        mine[find2(at[r.a])] = find2(at[r.b])
    assert {frozenset(i for i in range(len(vals)) if find(i) == k) for k in map(find, range(len(vals)))} == {frozenset(i for i in range(len(vals)) if find2(i) == k) for k in map(find2, range(len(vals)))}


@pytest.mark.parametrize("width", [35, 5, 2])
def test_substring_dedup(docs, rows, width, monkeypatch):
    seen, own = Counter(), {}
    for i, t in rows:
        own[i] = (t or "").encode().split()
        seen.update(b" ".join(own[i][k : k + width]) for k in range(len(own[i]) - width + 1))
    want = {}
    for i, w in own.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if seen[b" ".join(w[k : k + width])] > 1:
                gone[k : k + width] = True
        want[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    for limit, hot in ((1 << 26, 1 << 16), (0, 3), (1 << 26, 3)):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, width, broadcast_bytes=limit).collect()}
        assert got == want


def test_rans_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 600, 70001, 1_200_000):
        ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        table = rans.Table.from_bytes(rans.Table.of(np.bincount(ids, minlength=5001)).to_bytes())
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
    opened = rans._open(block)
    lanes, every = opened[1], opened[2]
    assert opened[3] > 1 and (rans.decode_from(block, table, 1) == ids[every * lanes : 2 * every * lanes]).all()
    for at in (40, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([5000], np.uint32), table)


STRANGE = ["", None, " ", " a", "a  b", "x　 y <|endoftext|>  z<|endoftext|>", "e ́x", "H̱,x É ×,a ü;Ü 7 a7,7b ７", "ſ ŉ İ ΑΣ Σ", "a\x1c b\x85 c", "don't  we'll a,'s b','s !x? ,'re x'y", " ,a; a. B", "   "]


@pytest.mark.parametrize("special", [False, True])
def test_tokens_equal_the_library(rows, special):
    texts = [t for t in STRANGE if special or "<|" not in (t or "")] + [t for _, t in rows[:150]]
    arr = pa.array(texts, pa.string())
    path = tokenizer_path("byte_bpe_50k.json")
    want = tokens.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert tokens.count_tokens(arr, path).tolist() == [len(e) for e in want]
    path = tokenizer_path("word_bpe_49k.json")
    want = tokens.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, at = tokens.token_ids(arr, path)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in want]
    counter = tokens.IdCounter(path)
    counter.add(arr)
    n = counter.counts()
    assert (n == np.bincount(ids, minlength=len(n))).all()


@pytest.mark.parametrize(("chunk", "overlap"), [(1000, 50), (300, 20), (32768, 512)])
def test_long_texts_are_spliced(rows, chunk, overlap):
    tok = tokens.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    for text in ("word " * 8000, "x" * 5000 + " y", "  ".join(t or "" for _, t in rows[:40]), "ab" * 3000 + " " + "cd " * 4000, " " * 3000 + "a" * 300 + " b" * 100, "日本語テキスト" * 500, "a<|endoftext|> b" * 900, "漢字と仮名、また漢字。終わり！" * 700, "aGVsbG8+d29ybGQ/Zm9v1x2Y" * 600, "don't,we'll's re'x1's" * 400):
        assert token_counts.count_long(text, tok, chunk, overlap) == len(tok.encode(text, add_special_tokens=False))


def test_token_counts(docs, rows):
    tok = tokens.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), chunk=5000).collect()}
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_token_files(spark, docs, rows, tmp_path, monkeypatch):
    import zlib

    monkeypatch.setattr(token_files, "BLOCK", 20_000)
    path = tokenizer_path("word_bpe_49k.json")
    tok = tokens.tokenizer(path)
    token_files.write_token_files(docs, str(tmp_path / "t"), path)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc), sorted(rows), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def licences_by_force(text, templates, scanner):
    """As the scanner, by comparing every window with every template."""
    cut = lambda x: re.findall("[a-z0-9]+", (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    pairs = list(itertools.pairwise(cut(text)))
    best, names, covered = (0.0, 0, None), set(), set()
    for name, texts in templates.items():
        for t in texts:
            own = Counter(itertools.pairwise(cut(t)))
            m = sum(own.values())
            for n in {min(n, len(pairs)) for n in scanner._lengths(m, license_scan.STEP)} if m and pairs else ():
                for i in range(len(pairs) - n + 1):
                    dice = 2 * sum((own & Counter(pairs[i : i + n])).values()) / (m + n)
                    if dice >= scanner.threshold - 1e-12:
                        names.add(name)
                        covered |= set(range(2 * i, 2 * (i + n) + 1))
                        best = min(best, (-dice, -m, name), key=lambda x: (x[0], x[1], x[2] or ""))
    stretches = sum(k - 1 not in covered for k in covered)
    return stretches, sorted(names), best[2], round(-best[0], 6) + 0.0


def test_licences_by_force(spark, rows):
    short = {k: [t for t in v if len(t) < 200] for k, v in license_scan.licence_templates().items()}
    notice = short["GPL-3.0"][0]
    extra = [
        (1, "see x\nreleased UNDER the mit\n * license\ny"), (2, "All" + " " * 2000 + "rights reserved."), (3, "All"), (4, notice + " and " + notice), (5, notice.replace("General", "Very General")),
        (6, "Licensed under the Apache Licence Version 2.0 only"), (7, "all rights all rights reserved reserved " * 4), (8, "Copyright 2020 Acme. All rights reserved. Licensed under CC BY-NC 4.0."), (9, "# " + notice.replace(" ", "\n# ")),
    ]
    data = [(i, t) for i, t in rows if len(t or "") < 1500][:120] + extra
    for threshold in (0.8, 0.5, 1.0):
        scanner = license_scan.Scanner(short, threshold)
        want = {i: licences_by_force(t, short, scanner) for i, t in data}
        df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "_text", "n_matches", "licences")})
        got = {r.doc_id: (r.n_matches, r.licences, r.best_licence, r.best_dice) for r in license_scan.scan_licences(df, threshold, short).collect()}
        assert got == want
    assert want[2][0] == 1 and want[9][3] == 1.0


def test_full_licences_are_found():
    templates = license_scan.licence_templates()
    scanner = license_scan.Scanner(templates, 0.8)
    filler = [f"word{k}" for k in range(700)]
    for path in ("MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Zlib"):
        text = templates[path][-1]
        hidden = " ".join(filler + text.upper().split() + filler)  # one line among other words
        changed = text.split()
        changed[5:5] = ["Copyright", "2021", "Acme"]
        column = pa.array([text, hidden, "\n".join(f" * {x}" for x in text.split("\n")), " ".join(changed), None, text + "\n\nlast words\n" + text])
        found = scanner.scan(column)
        assert [path in f[1] for f in found] == [True, True, True, True, False, True]
        assert found[0][3] == 1.0 and found[1][3] == 1.0 and found[1][2] == path
    assert scanner.scan(pa.array([" ".join(filler)])) == [(0, [], None, 0.0)] and scanner.scan(pa.array([], pa.string())) == []


def test_exact_dedup(spark, rows, monkeypatch):
    more = [*rows, (95001, rows[0][1]), (95001, rows[0][1]), (None, rows[0][1]), (95002, "same start " * 30 + "1"), (95003, "same start " * 30 + "2")]
    df = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "_len", "_n", "_key", "_row", "_again", "kept", "_at", "_p")})
    groups = {}
    for i, t in more:
        groups.setdefault(t or "", []).append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in more)
    full = bitmap.marked
    for mark in (full, lambda df, key, keys, flag: df.withColumn(flag, F.lit(True))):  # a bitmap that lets all rows through
        monkeypatch.setattr(exact_dedup, "marked", mark)
        got = exact_dedup.exact_dedup(df).collect()
        assert len(got) == len(more)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)


def test_water_filling(spark):
    def fill(sizes, weights):
        plan = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, _total long, _weight long")
        return [r._target for r in curriculum.water_fill(plan).orderBy("i").collect()]

    assert fill([100, 100], [1, 3]) == [50.0, 150.0]
    assert fill([10, 1000], [3, 1]) == [30.0, 980.0]
    assert fill([0, 0], [1, 2]) == [0.0, 0.0]
    t = fill([1, 5, 900, 40], [3, 3, 1, 2])
    assert sum(t) == pytest.approx(946) and t[0] == 3 and t[1] == 15
    assert fill([5], [2]) == [5.0] and fill([], []) == []


def test_mix(spark, rows):
    data = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = curriculum.mix(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.mix_source] += r.size
        taken[r.mix_source] += r.taken
        target[r.mix_source] = r.target
        assert 0 <= r.taken <= 3 * r.size and sum(p.words for p in r.places) == r.taken
        assert all(0 <= p.position <= 1 for p in r.places)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, curriculum.mix(df.repartition(3)).collect())) == sorted(map(str, got))
    # The share of a source's words read by time p is the integral of its weight, at every place.
    for k, s in enumerate(sorted(x for x in target if x is not None)):
        w0, w1 = 1.5 - k / (len(target) - 1), 0.5 + k / (len(target) - 1)
        before = 0
        for p, w in sorted((p.position, p.words) for r in got if r.mix_source == s for p in r.places):
            assert before / taken[s] == pytest.approx((w0 * p + (w1 - w0) * p * p / 2) / ((w0 + w1) / 2), abs=1e-9)
            before += w
    first = [r.places[0].position if r.places else 2 for r in curriculum.by_position(curriculum.mix(df)).coalesce(1).collect()]
    assert first == sorted(first)
    # Whole documents: each source's words are off its target by half of one document at most.
    texts, words, most = {i: t for i, t, _ in data}, Counter(), Counter()
    out = curriculum.training_order(df.withColumns({c: F.lit(1) for c in ("_id", "_size", "_place", "d0", "row", "m0")}))
    assert out.columns[:4] == df.columns
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        n = len((r.text or "").encode().split())
        words[r.source] += n
        most[r.source] = max(most[r.source], n)
    assert all(abs(words[s] - target[s]) <= most[s] / 2 + 0.5 for s in target)
    # Rows that share an id, or all they hold, are read as often as they are taken.
    again = spark.createDataFrame([(None, "a b c", "s")] * 5 + [(1, "x y", "s")] * 2 + [(1, "z", "t")], "doc_id long, text string, source string")
    mixed = curriculum.mix(again, whole=True).collect()
    assert Counter(r.source for r in curriculum.training_order(again).collect()) == +Counter({s: sum(len(r.places) for r in mixed if r.mix_source == s) for s in "st"})




def test_huge_texts_without_spaces_stay_in_chunks(monkeypatch):
    tok, sizes = tokens.tokenizer(tokenizer_path("byte_bpe_50k.json")), []

    class Watched:
        def encode(self, text, add_special_tokens):
            sizes.append(len(text))
            return tok.encode(text, add_special_tokens=add_special_tokens)

    text = "漢字と仮名、また漢字。終わり！abc123def+/" * 3000
    assert token_counts.count_long(text, Watched(), 2000, 64) == len(tok.encode(text, add_special_tokens=False)) and max(sizes) <= 4000


def test_isotonic_by_force():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 40):
        y, w = rng.normal(size=n).round(1), rng.integers(1, 5, n).astype(float)
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert rff_quality.isotonic(y, w) == pytest.approx(want)


def test_ridge_from_partition_sums(spark):
    rng = np.random.default_rng(9)
    data = [(i, rng.normal(size=len(rff_quality.NAMES)).tolist(), float(i % 3 > 0)) for i in range(400)]
    stats = spark.createDataFrame([(i, s) for i, s, _ in data], "_id long, stats array<double>").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "_id long, label double")
    model = rff_quality.fit(stats, labels)
    kept = {r._id for r in stats.where(~gru_langid.held_out(F.col("_id"), 3, 1) & (F.pmod(F.xxhash64(F.lit("calibrate"), F.col("_id").cast("string")), F.lit(rff_quality.CALIBRATE)) > 0)).collect()}
    x = model.features(np.array([s for i, s, _ in data if i in kept]))
    y = np.array([v for i, _, v in data if i in kept])
    f = rff_quality.FEATURES
    penalty = rff_quality.RIDGE * len(x) * np.eye(f + 1) * np.append(np.ones(f) * 2 / f, 1e-6)
    assert model.beta == pytest.approx(np.linalg.solve(x.T @ x + penalty, x.T @ y), rel=1e-5, abs=1e-7)


def test_language_probabilities_by_force():
    rng = np.random.default_rng(3)
    net = gru_langid.Network(["de", "en", "fr"], gru_langid._init(3, rng))
    texts = ["ab c" * 70, "", "x", "é" * 64 + "y"]
    data, at = words.utf8(pa.array(texts))
    got, w, k = gru_langid.pooled(net, data, at), net.weights, gru_langid.HIDDEN

    def states(x, h, raw):
        s, out = np.zeros(k), []
        for byte in raw:
            g, u = x[:, byte].astype(float), h.astype(float) @ s
            z, r = (1 / (1 + np.exp(-(g[a : a + k] + u[a : a + k]))) for a in (0, k))
            new = np.tanh(g[2 * k :] + r * u[2 * k :])
            s = new + z * (s - new)
            out.append(s)
        return out

    for i, t in enumerate(texts):
        raw, total = t.encode(), np.zeros(3)
        for a in range(0, len(raw), gru_langid.WINDOW):
            part = raw[a : a + gru_langid.WINDOW]
            padded = part + b" " * (gru_langid.WINDOW - len(part))
            f, b = states(w["fw_x"], w["fw_h"], padded), states(w["bw_x"], w["bw_h"], padded[::-1])[::-1]
            for p in range(len(part)):
                e = np.exp(w["out"] @ np.concatenate([f[p], b[p]]) + w["bias"][:, 0])
                total += e / e.sum()
        assert got[i] == pytest.approx(total / max(1, len(raw)), abs=1e-4)


def test_languages_of_any_number_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(gru_langid, "TRAIN_DOCS", 6)
    seen = {}
    monkeypatch.setattr(gru_langid, "train", lambda windows, mask, label, langs: seen.update(n=np.bincount(label).tolist(), langs=langs) or gru_langid.Network(langs, {}))
    rows = [(i, f"text number {i}", "aa") for i in range(3000)] + [(None, "one text without id", "bb")] * 50 + [(9000 + i, f"other {i}", "cc") for i in range(40)]
    gru_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen["langs"] == ["aa", "bb", "cc"] and min(seen["n"]) >= 1  # a language of 3000 documents is there, as is one of a single text


def test_repeated_rows_long_texts_and_clashing_names(spark, empty, tmp_path):
    some = [(1, "one text of some words", "en", "s"), (2, "word " * 40_000, "en", None), (3, None, None, "s"), (4, "", "fr", "s"), (5, "un texte de quelques mots", "fr", "t")]
    names = ("_id", "_text", "_row", "_w", "_len", "_part", "k1", "k2", "_source", "_size", "_draw", "sid", "row", "fp", "letters", "part", "first", "c0", "stats", "_at", "_p", "_null")
    df = spark.createDataFrame(some * 2, empty.schema).repartition(3).withColumns({c: F.lit("x") for c in names})
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    path = tokenizer_path("byte_bpe_50k.json")
    token_files.write_token_files(df, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    for out in (
        decontaminate.find_contamination(df, bench), token_counts.token_counts(df, path), simhash.near_duplicates(df), simhash.near_duplicates(df, width=5, similarity=0.8), substring_dedup.remove_repeats(df),
        token_files.read_token_files(spark, str(tmp_path / "t")).withColumnRenamed("doc", "doc_id").drop("start"), license_scan.scan_licences(df), exact_dedup.exact_dedup(df).drop("kept"), rff_quality.quality(df, labels), gru_langid.language_id(df),
    ):
        got = Counter(map(str, out.collect()))
        assert sum(got.values()) == 10 and len(got) == 5
    mixed = curriculum.mix(df).collect()
    assert len(mixed) == 10 and all(0 <= r.taken <= 3 * r.size for r in mixed)


@pytest.mark.parametrize("kind", ["decimal(12,0)", "smallint", "double", "string"])
def test_token_files_of_other_ids(spark, tmp_path, kind):
    df = spark.createDataFrame([(3, "c"), (1, "a a"), (None, "none"), (1, "a")], "doc_id int, text string").select(F.col("doc_id").cast(kind), "text")
    token_files.write_token_files(df, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc is None for r in got] == [True, False, False, False] and float(got[-1].doc) == 3


def test_isotonic():
    assert rff_quality.isotonic(np.array([1.0, 0.0, 2.0]), np.ones(3)).tolist() == [0.5, 0.5, 2.0]
    assert rff_quality.isotonic(np.array([0.1, 0.2]), np.ones(2)).tolist() == [0.1, 0.2]


def test_quality(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        w = [rng.choice("alpha beta gamma delta of the and to house river".split()) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join([w[0]] * 30 + [x.upper() + "!!" for x in w[:20]])))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, ""), (5002, "x")]
    got = {r.doc_id: r for r in rff_quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert len(held) > 200 and np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.97
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got.values())
    none = rff_quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in none.select(F.round("score", 1).alias("score")).collect()} == {0.5}


def test_gru_gradients():
    rng = np.random.default_rng(0)
    h = rng.normal(size=(3 * 4, 4)).astype(np.float32) * 0.5
    x = rng.normal(size=(3 * 4, 256)).astype(np.float32) * 0.5
    text = rng.integers(0, 5, (6, 3)).astype(np.uint8)
    loss = lambda a, b: float((gru_langid._direction(a, b, text).astype(np.float64) ** 2).sum())
    keep = []
    out = gru_langid._direction(x, h, text, keep)
    dx, dh = gru_langid._backward(h, x.shape, text, keep, 2 * out)
    for m, d in ((x, dx), (h, dh)):
        for _ in range(12):
            i, j = int(rng.integers(0, m.shape[0])), int(rng.integers(0, 4))
            up, down = m.copy(), m.copy()
            up[i, j] += 1e-2
            down[i, j] -= 1e-2
            num = (loss(up, h) - loss(down, h) if m is x else loss(x, up) - loss(x, down)) / 2e-2
            assert d[i, j] == pytest.approx(num, rel=0.05, abs=0.02)


def test_language_id(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", "fr", "s", 0), (90003, "123 ... !", None, "s", 0)], df.schema)
    got = {r.doc_id: r for r in gru_langid.language_id(df.union(odd)).collect()}
    lang = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i in lang if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.9
    assert all(got[i].lang_pred == "und" for i in (90001, 90002, 90003)) and len(got) == len(lang) + 3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([(1, "some item text")], "item_id long, text string")
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(empty.union(spark.createDataFrame([(1, "a b", "x", "y")], empty.schema)), bench.limit(0)).first().n_words == 2
    assert token_counts.token_counts(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert curriculum.mix(empty).count() == 0
    assert license_scan.scan_licences(empty).count() == 0
    assert rff_quality.quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert gru_langid.language_id(empty).count() == 0
    token_files.write_token_files(empty, str(tmp_path / "e"), tokenizer_path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols = docs.columns
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34", "en", "s", 0), (90003, docs.first().text, None, None, None)], docs.schema)
    a = P.language(spark, docs.union(odd), small).cache()
    assert a.columns == cols and {90001, 90002}.isdisjoint(r.doc_id for r in a.collect()) and a.count() >= docs.count() * 0.99
    b = P.near_dedup(spark, a, small).cache()
    near = simhash.near_duplicates(a, width=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in b.collect()) == sorted({r.component_id for r in near})
    c = P.decontamination(spark, b, small).cache()
    bad = {r.doc_id for r in decontaminate.find_contamination(b, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - bad
    d = P.mixing(spark, c, small).cache()
    assert d.columns == cols and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    e = P.token_output(spark, d, small)
    assert e.count() == d.count()
    assert [name for name, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
