"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomlight.llm import bpe, chat, decontamination, html_text, langid, near_dups, packing, quality, resampling, suffixes, toxicity
from loomlight.llm import bytebatch as bb

R = random.Random(3)
EXTRA = ", row long, n_words string, score string"  # names that clash with results


def words(n, alphabet="abcdefgh"):
    return " ".join("".join(R.choice(alphabet) for _ in range(R.randint(2, 7))) for _ in range(n))


BASE = words(400)
TEXTS = [None, "", " \n", "a", BASE, BASE, BASE.replace("a", "A"), BASE + " tail", words(120), "z" * 3000, words(90) + " é ü " + words(5), "x " * 900, BASE[300:1200] + " " + words(30), "..."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", 0, "n", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 if i in (4, 8) else 0) for i in range(14)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_match_the_patterns():
    texts = [t or "" for t in TEXTS] + ["ÀB-c9\tdé\x0bF"]
    for kind, pattern in ((bb.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bb.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        for t in bb.blocks(pa.array(texts), 500):
            w = bb.words(t, kind)
            for i in range(len(t)):
                lower = re.sub("[A-Z]", lambda m: m[0].lower(), t.row(i).decode())
                assert len(re.findall(pattern, lower)) == w.offs[i + 1] - w.offs[i]


def plain_hits(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda s: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w, hit, found = low(text), set(), set()
    for i, t in items:
        v = low(t)
        n = min(13, len(v))
        for p in range(len(v) - n + 1 if v else 0):
            for q in range(len(w) - n + 1):
                if w[q : q + n] == v[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(i)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontamination(spark, docs, empty, block_bytes):
    w = BASE.split()
    items = [(1, " ".join(w[20:60])), (2, " ".join(w[5:9])), (3, None), (4, "qq ww ee"), (None, BASE), (10, " ".join(w[30:43])), (10, " ".join(w[30:43])), (5, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for carry in (False, True):
        got = by_id(decontamination.decontaminate(docs, table, block_bytes=block_bytes, carry=carry))
        for i, t in enumerate(TEXTS):
            n, hit, found = plain_hits(t, [x for x in items if x[0] is not None])
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
            assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontamination.decontaminate(empty, table).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, table.limit(0)).collect())


def test_near_dups(docs, empty):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(near_dups.group(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert near_dups.group(empty).count() == 0


def test_near_dups_of_repeated_ids(spark):
    """Rows of one id with other texts are other documents; one row of each group stays."""
    more = BASE + " two words"
    rows = [(1, words(50)), (1, BASE), (2, more), (2, more), (3, more), (None, BASE), (None, BASE), (4, None), (4, "")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, kept string").repartition(2)
    got = near_dups.group(frame, rows=True).collect()
    linked = [r for r in got if r["n_shingles"] > 300 and r["doc_id"] is not None]
    assert len(got) == len(rows) and len(linked) == 4 and {r["component_id"] for r in linked} == {1} and sum(r["stays"] for r in linked) == 1
    assert all(r["kept"] == (r["doc_id"] == 1) and (r["kept"] or not r["stays"]) for r in linked)
    assert all(r["stays"] and r["kept"] for r in got if r["doc_id"] in (None, 4))


def test_near_dups_in_crowded_buckets(spark, monkeypatch):
    """Variants of one text, of every distance to it, and texts that share a passage: as brute force, by either way."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    rows = []
    for k in range(160):
        w = list(base)
        for at in rnd.sample(range(len(w)), rnd.randrange(0, 6)):
            w[at] = f"x{rnd.randrange(10**6)}"
        if k % 4 == 0:
            w = base[:60] + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 40))]
        rows.append((k, " ".join(w)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {i: low if c == high else c for i, c in want.items()}
    assert 10 < len(set(want.values())) < 150
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (1, near_dups.CROWDED, 10**6):
        monkeypatch.setattr(near_dups, "CROWDED", crowded)
        assert {r["doc_id"]: r["component_id"] for r in near_dups.group(frame).collect()} == want


def test_near_dups_estimate_is_close():
    s = np.unique(np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64))
    a, b = near_dups.packed(near_dups.minima(s[:1700])), near_dups.packed(near_dups.minima(s[200:]))
    x = a ^ b
    differ = sum(int(v).bit_count() for v in (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    assert abs(((1 - differ / near_dups.HASHES) - 0.25) / 0.75 - 1500 / len(s)) < 0.2


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r["id"]: r["component"] for r in near_dups.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {51: 50}


def covered(units, seen, length, enough):
    gone = np.zeros(len(units), bool)
    for k in range(len(units) - length + 1):
        if enough(seen[tuple(units[k : k + length])]):
            gone[k : k + length] = True
    return gone


def check_suffixes(spark, texts, monkeypatch=None, **options):
    """remove_repeats over texts (repeated doc_id, clashing names) against brute force."""
    length, word, across = options.get("length", 400), options.get("unit") == "word", options.get("across", False)
    split = (lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) if word else (lambda t: list((t or "").encode()))
    seen = {}
    for i, t in enumerate(texts):
        u = split(t)
        for k in range(len(u) - length + 1):
            seen.setdefault(tuple(u[k : k + length]), []).append(i)
    enough = (lambda where: len(set(where)) > 1) if across else (lambda where: len(where) > 1)
    frame = spark.createDataFrame([(i, t, "a", "b", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, units string, m long").repartition(3)
    got = by_id(suffixes.remove_repeats(frame, carry=True, **options))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        gone = covered(split(t), seen, length, enough)
        raw = (t or "").encode()
        if word:
            starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
            bytes_gone = np.zeros(len(raw), bool)
            for k in np.flatnonzero(gone):
                bytes_gone[starts[k] : starts[k + 1]] = True
            gone = bytes_gone
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), int(gone.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["input_row"]["m"] == i
        assert r["text"] == (None if t is None else kept.decode(errors="ignore"))


@pytest.fixture(scope="module")
def shared_passages():
    """Texts that share passages of every length about 60 words, within and across texts, with periodic parts."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    pool = [[word() for _ in range(rnd.randint(40, 90))] for _ in range(6)]
    out = [None, "", "  ", "ab " * 300, "ab " * 260 + "c", "q" * 900]
    for _ in range(40):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 12)
            parts += p[a : len(p) - rnd.randint(0, 12)] if rnd.random() < 0.7 else [word() for _ in range(rnd.randint(1, 60))]
        out.append(rnd.choice([" ", "  "]).join(parts))
    return out + out[20:24] + out[20:21]


@pytest.mark.parametrize("options", [{}, {"across": True}, {"length": 60, "gram": 13}, {"length": 50, "gram": 20, "unit": "word"}, {"length": 50, "gram": 20, "unit": "word", "across": True}, {"length": 9, "gram": 9, "unit": "word", "across": True}])
def test_suffixes(spark, shared_passages, monkeypatch, options):
    check_suffixes(spark, shared_passages, **options)
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    check_suffixes(spark, shared_passages, **options)


def test_suffixes_of_odd_tables(spark, docs, empty):
    check_suffixes(spark, TEXTS)
    assert suffixes.remove_repeats(empty).count() == suffixes.remove_repeats(empty, carry=True, across=True).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000))
    check = by_id(suffixes.remove_repeats(spark.createDataFrame([(1, long), (1, None), (2, "x" + long[5000:9000])], "doc_id long, text string").where("text is not null")))
    assert check[1]["n_removed"] == check[2]["n_removed"] == 4000


def test_suffixes_across_bucket_boundaries():
    """Sorted suffixes dealt to buckets of any sizes get the flags that one bucket gives."""
    rnd = random.Random(2)
    for trial in range(60):
        across = trial % 2 == 0
        reach = 2 if across else 1
        rows = sorted((rnd.randint(0, 3), rnd.randint(0, 2), 0, rnd.randint(0, 3), k) for k in range(rnd.randint(1, 25)))
        table = lambda part: pa.record_batch([pa.array([r[c] for r in part], pa.int64()) for c in (0, 1, 2, 3, 4)], names=["m", "d1", "d2", "row", "a"])
        streaks = sorted({r[:4] for r in rows}) if across else rows
        want = {}
        for s in streaks:
            same = [x for x in streaks if x[0] == s[0] and x != s]
            want[s] = any(x[1] == s[1] for x in same)
        cuts = sorted({0, len(rows), *(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 6)))})
        if across:  # a streak is never split
            cuts = [c for c in cuts if c in (0, len(rows)) or rows[c][:4] != rows[c - 1][:4]]
        found = []
        for task, (x, y) in enumerate(zip(cuts, cuts[1:])):
            part = rows[x:y]
            step = rnd.randint(1, 5)
            for b in suffixes.compare_neighbours((table(part[i : i + step]) for i in range(0, len(part), step)), across, reach, task):
                found += b.to_pylist()
        patch = {(t, e): (w, p) for t, e, w, p in suffixes.across_boundaries(list({(r["task"], r["edge"], r["m"], r["d1"], r["d2"]) for r in found if r["edge"]}), reach)}
        flags = {}
        for r in found:
            more = patch.get((r["task"], r["edge"]), (False, False))
            flags[(r["m"], r["d1"], r["d2"], r["row"], r["a"])] = (r["whole"] or more[0], r["part"] or more[1])
        for r in rows:
            assert flags.get(r, (False, False))[0] == want[r[:4] if across else r]
        for m in {r[0] for r in rows}:  # covers of one token: each has a row in the byte compare, and two if it has two texts
            mine = [r for r in rows if r[0] == m]
            covers = {r[1] for r in mine}
            for c in covers if len(covers) > 1 else ():
                sent = {r[3] for r in mine if r[1] == c and flags.get(r, (0, 0))[1]}
                assert len(sent) >= min(2 if across else 1, len({r[3] for r in mine if r[1] == c}))


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, (400, 6)).astype(np.uint64) << np.uint64(60)
    group = np.sort(rng.integers(0, 9, 400))
    order = suffixes.multikey_quicksort(tokens, group)
    got = [(group[i], *tokens[i].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(400)) and got == sorted(got)
    shared = suffixes.common(tokens[order], group[order], 8)
    for k in range(1, 400):
        x, y = (tokens[order[j]].astype(">u8").tobytes() for j in (k - 1, k))
        same = next((i for i in range(48) if x[i] != y[i]), 48)
        assert shared[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_packing(docs, empty):
    got = [r.asDict() for r in packing.pack(docs).collect()]
    tok = bpe.with_offsets(bpe.read(None))
    full = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.array([*tok.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["start"] + r["length"] == len(ids) or r["length"] == 1024 or r["piece"] == 0
    assert max(full.values()) <= 1024 and {r["doc_id"] for r in got} == set(range(len(TEXTS)))
    assert packing.pack(empty).count() == 0


def test_packing_plan_holds_everything_tightly():
    histogram = dict(Counter(R.randint(1, 1024) for _ in range(5000)))
    runs = packing.plan(histogram, 1024)
    placed = Counter()
    for n, inside in runs:
        assert sum(inside) <= 1024
        for x in inside:
            placed[x] += n
    assert placed == histogram
    assert sum(n for n, _ in runs) <= 1.02 * sum(x * n for x, n in histogram.items()) / 1024 + 1


def test_packing_places_large_pieces_by_the_groups():
    """The large pieces of every sequence are those of a configuration; only small ones are put in best-fit."""
    lengths = np.random.default_rng(4).integers(1, 1025, 3000)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    kept = sorted(((x, n) for x, n in histogram.items() if 256 < x < 1024), reverse=True)
    wanted = []
    for groups in (64, 128, 256, 512, 1024, 2048, 4096):
        large = packing._groups(kept, groups)
        configurations = packing._configurations([g[0][0] for g in large], [sum(n for _, n in g) for g in large], 1024)
        wanted.append(Counter())
        for n, inside in packing._substitute(configurations, large):
            wanted[-1][tuple(sorted(inside))] += n
    got, placed = Counter(), Counter()
    for n, inside in packing.plan(histogram, 1024):
        assert sum(inside) <= 1024
        if part := tuple(sorted(x for x in inside if 256 < x < 1024)):
            got[part] += n
        for x in inside:
            placed[x] += n
    assert got in wanted and placed == histogram


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|start|>user\n", "<\\|x <\\\\|", "[\\INST]", "", None, "é\n\n  <<SYS>>", "<|end|>"]
    assert all(chat.unescape(chat.escape(t or "")) == (t or "") for t in nasty)
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(nasty)] + [(2, 0, None, "hi", 0), (None, 0, "assistant", "x", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long")
    whole = by_id(chat.format_chats(table, block_chars=1 << 40), "conv_id")
    for block in (1 << 20, 5):
        got = by_id(chat.format_chats(table, block_chars=block), "conv_id")
        assert got == whole
        said = [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
        assert got[1]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest() and got[1]["loss_chars"] == sum(map(len, said))
        assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows if r[0] == 1).encode()).hexdigest()
        assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert chat.format_chats(table.limit(0)).count() == 0


def plain_model(votes, n, rounds=60):
    """The label model by plain loops of EM."""
    rules = votes.shape[1]
    share = np.array([0.85] + [0.15 / rules] * rules)
    bad = np.full((rules + 1, rules), 0.1)
    bad[0] = 0.02
    bad[np.arange(1, rules + 1), np.arange(rules)] = 0.8
    heavy = 100 + 0.5 * n.sum()
    for _ in range(rounds):
        log = np.log(share) + np.stack([np.where(votes == -1, np.log(b), np.where(votes == 1, np.log1p(-b), 0)).sum(1) for b in bad], 1)
        q = np.exp(log - log.max(1, keepdims=True))
        q *= (n / q.sum(1))[:, None]
        share = (q.sum(0) + 1) / (n.sum() + rules + 1)
        for k in range(rules + 1):
            for j in range(rules):
                hit, voted = q[votes[:, j] == -1, k].sum(), q[votes[:, j] != 0, k].sum()
                bad[k, j] = (hit + 0.02 * heavy) / (voted + heavy) if k == 0 else (hit + 1) / (voted + 2)
    return share, bad


def test_quality(spark, docs, empty):
    more = [None, "word " * 12 + "\n" + "other words here.\n" * 3 + "#$ |<>", "A B C! D? " * 9, " ".join(f"w{k}" for k in range(30_000)) + "."]
    rows = list(enumerate(TEXTS + more)) + [(4, BASE)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, votes string")
    got = [r.asDict() for r in quality.judge(frame).collect()]
    assert len(got) == len(rows)
    for i, t in dict(rows).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        for r in (r for r in got if r["doc_id"] == i):
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
            assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
            assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert quality.judge(empty).count() == 0


def test_quality_model_is_em(spark):
    """Estimates of plain EM; agreeing votes reject."""
    rng = np.random.default_rng(6)
    good = np.where(rng.random((3000, 4)) < [0.06, 0.004, 0.004, 0.004], -1, 1)
    bad = np.where(rng.random((400, 4)) < [0.7, 0.8, 0.7, 0.02], -1, 1)
    votes = np.concatenate([good, bad])
    votes[rng.random(votes.shape) < 0.1] = 0
    u, n = np.unique(votes, axis=0, return_counts=True)
    patterns = spark.createDataFrame([(list(map(int, v)), int(k)) for v, k in zip(u, n)], "votes array<int>, n long")
    share, chances = quality.label_model(patterns, 4)
    want = plain_model(u, n)
    assert np.allclose(share, want[0], rtol=1e-6) and np.allclose(chances, want[1], rtol=1e-6)
    p = {tuple(r["votes"]): r["p"] for r in patterns.selectExpr("votes", quality.posterior(share, chances) + " as p").collect()}
    assert p[(1, 1, 1, 1)] > 0.99 and p[(-1, -1, 1, 1)] < 0.05 and p[(-1, -1, -1, 1)] < 0.01


def test_quality_is_no_filter(spark):
    """Some documents that one rule votes against are kept, and none of those that three are against."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    votes = quality.counts(docs, "doc_id", "text").selectExpr("doc_id", "array(" + ", ".join(quality._vote(r) for r in quality.RULES) + ") as votes")
    got = quality.judge(docs).join(votes.selectExpr("doc_id", "size(filter(votes, v -> v = -1)) as against"), "doc_id").groupBy("against", "kept").count().collect()
    n = {(r["against"], r["kept"]): r["count"] for r in got}
    assert n[(0, True)] > 700 and n[(1, True)] > 5 and n[(1, False)] > 5 and not any(k and a >= 3 for a, k in n)


def test_language_id(spark, docs, empty):
    rows = [(i, words(60, "abcdef" if i % 2 else "uvwxyz"), "aa" if i % 2 else "uu") for i in range(60)] + [(90, None, "aa"), (91, "12 ..", "aa"), (92, "éé", None)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60] if got[i]["held_out"])
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and 0 <= got[92]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert langid.identify(empty).count() == 0 and langid.identify(docs, carry=True).count() == len(TEXTS)


def plain_ppm(texts, symbols):
    """A function (context, symbol) -> bits, by walking the tree of one language symbol by symbol."""
    tree = {}
    for t in texts:
        padded = [0] * langid.ORDER + t
        for i, x in enumerate(t):
            for o in range(langid.ORDER + 1):
                node = tree.setdefault(tuple(padded[i + langid.ORDER - o : i + langid.ORDER]), Counter())
                node[x] += 1

    def chance(o, context):
        if o < 0:
            return np.full(symbols, 1 / symbols)
        node = tree.get(tuple(context[langid.ORDER - o :]))
        shorter = chance(o - 1, context)
        if not node:
            return shorter
        total, kinds = sum(node.values()), len(node)
        left = 1 - sum(shorter[k] for k in node)
        if left <= 1e-9:
            return np.array([node.get(k, 0) / total for k in range(symbols)])
        return np.array([node[k] / (total + kinds) if k in node else kinds / (total + kinds) * shorter[k] / left for k in range(symbols)])

    return lambda context, x: -np.log2(chance(langid.ORDER, context)[x])


def test_code_lengths_are_those_of_the_tree():
    """Proper chances, and sums of code lengths as a walk through each language's tree gives them; any script."""
    rows = [("aa", words(200)), ("bb", words(150, "xyzа")), ("bb", "Ωδ x"), ("cc", words(80, "кирлц"))]
    model = langid.train(rows)
    langs, table, nodes, bits = model
    size = int(table.max()) + 1
    assert np.allclose((2.0 ** -bits.astype(np.float64)).reshape(-1, size, len(langs)).sum(1), 1, atol=1e-4)
    node = langid.node_of(nodes, size)
    for text in (words(20), words(9, "xyz") + " Ωа!", "кцл 漢字 q", "A"):
        t = next(bb.blocks(pa.array([text])))
        codes = table[t.data].tolist()
        padded = [0] * langid.ORDER + codes
        got = bits[node[langid.contexts(np.array(codes), np.array([0]), langid.ORDER, size)] * size + np.array(codes)].sum(0)
        for k, lang in enumerate(langs):
            cost = plain_ppm([table[np.frombuffer(x.encode(), np.uint8)].tolist() for n, x in rows if n == lang], size)
            want = sum(cost(padded[i : i + langid.ORDER], x) for i, x in enumerate(codes))
            assert abs(got[k] - want) < 1e-3 * want + 0.01


def test_language_id_learns_from_no_held_out_row(spark):
    """Wrong labels of held-out rows, and a table bound that leaves few nodes, change nothing that matters."""
    rows = [(i, words(60, "abcdef" if i % 2 else "uvwxyz"), "aa" if i % 2 else "uu") for i in range(80)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wrong = [(i, t, ("zz" if held(i) else lang)) for i, t, lang in rows]
    a, b = ([tuple(r) for r in langid.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).orderBy("doc_id").collect()] for x in (rows, wrong))
    assert a == b and {r[2] for r in a} == {"aa", "uu"}


def test_toxicity(spark, docs, empty, labels):
    rows = [(i, words(40) + (" vileword" if i % 3 == 0 else "")) for i in range(300)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = by_id(toxicity.score(table, known))
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(300) if got[i]["held_out"]) and got[900]["predicted"] == 0
    assert toxicity.score(empty, labels).count() == 0 and toxicity.score(docs, labels.limit(0)).count() == len(TEXTS)


def test_resampling(spark, docs, empty, labels):
    """Weights and draw against plain counting over strings; k rows exactly, with nulls, repeats and ties."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, BASE)] * 9 + [(None, "a b c")] * 7 + [(50, " ".join(f"w{k % 999}" for k in range(40_000)))]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, kept int").repartition(3)
    good = {r[0] for r in labels.collect() if r[1] == 1 and r[0] is not None}

    def features(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())]
        return [(x,) for x in w] + list(zip(w, w[1:]))

    slot = {}
    for _, t in rows:
        for f in features(t):
            if f not in slot:
                text = b" ".join(f)
                r, b = resampling.features(bb.Texts(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
                slot[f] = int(b[len(f) - 1 if len(f) == 1 else 2])
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for i, t in rows:
        for f in features(t):
            raw[slot[f]] += 1
            target[slot[f]] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for fraction in (0.5, 0.2, 1.0):
        got = [r.asDict() for r in resampling.resample(frame, labels, fraction=fraction).collect()]
        k = int(len(rows) * fraction)
        assert sum(r["kept"] for r in got) == k
        text_of = dict(rows)
        for r in got:
            f = features(text_of[r["doc_id"]])
            assert r["n_features"] == len(f) and abs(r["log_weight"] - sum(ratio[slot[x]] for x in f)) < 1e-6
        order = sorted((-r["gumbel_key"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
        assert sorted((-r["gumbel_key"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["kept"]) == order[:k]
    assert resampling.resample(empty, labels).count() == 0 == resampling.resample(empty, labels.limit(0)).count()
    assert {r["log_weight"] for r in resampling.resample(docs, labels.limit(0)).collect()} == {0.0}


def test_kth_of_many(spark):
    frame = spark.range(3000).selectExpr("cast(id % 700 as double) / 7 as x", "id")
    values = sorted((k % 700) / 7 for k in range(3000))
    for k in (1, 5, 1499, 3000):
        v, left = resampling.kth(frame, k, "x", most=20)
        assert v == values[k - 1] and left == k - values.index(v)
    assert resampling.kth(spark.range(5000).selectExpr("id - 2500 as id"), 4000, "id", most=7) == (1499, 1)


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A &amp; b</h1><p>First  one.<p>Second<br>two &eacute;.</article><footer>&copy; x</footer>'
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<script>x")], "page_id long, url string, html string")
    got = by_id(html_text.extract(table), "page_id")
    assert got[1]["text"] == "A & b First one. Second two é." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == ""
    assert html_text.extract(table.limit(0)).count() == 0


def plain_text(page):
    """All text of a page outside raw elements and the head, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.raw = [], 0

        def handle_starttag(self, tag, attrs):
            self.raw += tag in html_text.RAW | {"head"}
            self.out.append(" " if tag not in html_text.INLINE else "")

        def handle_endtag(self, tag):
            self.raw -= tag in html_text.RAW | {"head"}
            self.out.append(" " if tag not in html_text.INLINE else "")

        def handle_data(self, data):
            if not self.raw:
                self.out.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    return " ".join("".join(r.out).split())


def test_html_leaves_lose_no_text(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert " ".join(b.text for b in html_text.leaves(row["html"])) == plain_text(row["html"])
    texts = lambda page: [b.text for b in html_text.leaves(page)]
    assert texts("<p title=it's>one</p><p>two</p><p>three it's</p>") == ["one", "two", "three it's"]
    assert texts('<p a="x>y" b=\'">\'>one <b>two</b></p>a < b <3 c<p>d') == ["one two", "a < b <3 c", "d"]
    assert texts('<p>a<i b="never closed>c</i> d</p><p>e') == ["ac d", "e"]
    assert texts("<p>a</p><i never closed") == ["a", "<i never closed"]
    assert texts("a<!doctype html>b<!-- c --> d<?x?><!-- e") == ["ab d"]
    for odd in ("<i " * 200_000, "<i x='\">'" * 100_000, '<p a="' * 100_000, "</" * 200_000, "<!" * 200_000, "<" * 300_000):
        html_text.leaves(odd)  # ends soon


def test_html_labels_unseen_layouts():
    """Held-out made-up pages, as they are and with class and id names that training never saw."""
    import random as rnd

    r = rnd.Random(991)
    model = html_text.trained()
    for rename, least in ((False, 0.97), (True, 0.85)):
        right = every = 0
        for _ in range(80):
            page = html_text.made_up_page(r)
            if rename:
                page = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="u{zlib.crc32(m[2].encode()) % 1000}"', page)
            blocks = html_text.leaves(page)
            label = np.array([b.text.startswith("\x02") for b in blocks])
            for b in blocks:
                b.text = b.text.lstrip("\x02").strip() or "."
            if blocks:
                z = model.logits(*html_text._padded([html_text.vectors(blocks)]))[0][0]
                right, every = right + int(((z > 0) == label).sum()), every + len(blocks)
        assert right >= least * every


def plain_pipeline(rows, items, tok):
    """(doc_id, piece, ids) of the kept documents, by sets, word windows and the tokenizers library."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    rows = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    first = {c: min((rows[k][0], k) for k in range(len(rows)) if label[k] == c)[1] for c in set(label)}
    rows = [rows[k] for k in sorted(first.values())]
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = split(t)
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(k)
    cleaned = []
    for i, t in rows:
        w, gone = split(t), set()
        for j in range(len(w) - 49):
            if len(seen[tuple(w[j : j + 50])]) > 1:
                gone.update(range(j, j + 50))
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
        lead = t[: starts[0]]
        cleaned.append((i, lead + "".join(t[starts[k] : starts[k + 1]] for k in range(len(w)) if k not in gone)))
    out = []
    for i, t in cleaned:
        n, hit, _ = plain_hits(t, items)
        if not (hit and 20 * hit >= n):
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
            out += [(i, k, zlib.crc32(ids[s : s + x].tobytes())) for k, (s, x) in enumerate(packing.cut(len(ids), 1024))]
    return sorted(out)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Nulls, repeated rows and ids, near copies, shared passages, benchmark text, a text of many pieces, clashing columns."""
    import corpus_pipeline

    rnd = random.Random(8)
    fresh = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passage, item, base = fresh(70), fresh(30), fresh(200)
    texts = [fresh(rnd.randint(8, 90)) for _ in range(20)]
    texts += [f"{fresh(40)} {passage} {fresh(30)}", f"{fresh(60)}\n{passage}  {fresh(9)}", passage[:200] + " " + fresh(50)]
    texts += [base, base, base + " tail", base.upper(), f"{item} {fresh(30)}", f"{fresh(900)} {item}", None, "", "12 34 ..", fresh(2500), "é " + fresh(30)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (5, fresh(40))]
    items = [(1, item), (2, None), (3, fresh(20))]
    frame = spark.createDataFrame([(i, t, rnd.choice(["aa", "bb"]), "s", len(t or ""), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == plain_pipeline(rows, items, bpe.with_offsets(bpe.read(None)))
    spark.createDataFrame([], frame.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_sends_texts_once_and_starts_no_other_workers(spark, docs, monkeypatch):
    """Carried rows hold no second copy of the text on their way to Python, and come back whole; no rows of Python's own make an RDD."""
    from loomlight.llm import cluster

    sent = docs.select(*cluster.carried_once(docs, "text", True))
    assert "text" not in sent.schema[cluster.CARRIED].dataType.names
    odd = docs.selectExpr("*", "cast(text as binary) as `Text too`", "doc_id as `a.b`")
    for frame in (docs, odd):
        for out in (langid.identify(frame, carry=True), decontamination.decontaminate(frame, spark.createDataFrame([(1, "no such words")], "item_id long, text string"), carry=True)):
            assert out.schema[cluster.CARRIED].dataType.names == frame.columns
            assert Counter(map(repr, out.select(f"{cluster.CARRIED}.*").collect())) == Counter(map(repr, frame.collect()))

    def refuse(*_, **__):
        raise AssertionError("an RDD of Python's rows")

    monkeypatch.setattr(suffixes, "across_boundaries", lambda edges, reach: [(0, 1, False, False)])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert suffixes.remove_repeats(docs).count() == docs.count()


def test_blocks_give_back_what_the_pool_keeps():
    used = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
    many = [pa.array(np.arange(1 << 16)).cast(pa.string()) for _ in range(200)]
    before = used()
    del many
    list(bb.blocks(pa.array(["a", None])))
    assert used() < before - 50


def test_special_tokens_are_those_of_the_library():
    raw = bpe.read(None)
    encode, tok = bpe.encoder(raw), bpe.with_offsets(raw)
    for t in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endo", "plain  text\n\n é"):
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = corpus_pipeline.written(out, "t")
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
