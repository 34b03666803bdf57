import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tests.llm.test_text_ops import ODD, docs
from tidemark.llm import quality_rules as qr
from tidemark.llm.license_scan import TEMPLATES, THRESHOLD, license_scan
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_sources, place_blocks, rows_a_block


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_stats(text):
    w = ws(text)
    seen, lines, dup = {}, set(), 0
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(8)}
    for line in (text or "").split("\n"):
        if ws(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics_brute(spark):
    r = random.Random(3)
    texts = ODD + ["\n".join(" ".join(r.choice(["a", "b#", "<c>", "é", "dd"]) for _ in range(r.randrange(25))) for _ in range(6)) for _ in range(60)]
    texts += ["Est " * 40, "x y z " * 9 + "tail", "a b c d e f g h", "a b c d e f g h " * 2]
    got = {x.doc_id: x for x in qr.apply_rules(docs(spark, texts), []).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute_stats(t)
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert g.base_failed == (n < 20 or 100 * rep > 30 * n) and g.kept == (not g.base_failed)


def test_rules_learned_and_pruned(spark):
    r = random.Random(5)
    rows = [(x := r.random(), y := r.random(), 0 if x > 0.8 and y < 0.5 else 1) for _ in range(3000)]
    rules = qr.learn(rows, ["x", "y"])
    hit = lambda row: any(all((row[["x", "y"].index(l.feature)] >= l.cut) == l.at_least for l in rule) for rule in rules)
    wrong = sum(hit(row) != (row[2] == 0) for row in rows)
    assert rules and wrong < 60
    assert qr.learn([], ["x"]) == [] and qr.learn([(1.0, 1)] * 9, ["x"]) == []
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert qr.quality_rules(docs(spark, ODD), labels).count() == len(ODD)
    assert qr.quality_rules(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    places = [(i, l) for p, l in base.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = {}
    for t in TEMPLATES:
        ts = set(t.split())
        least = THRESHOLD * len(ts) - 1e-9
        others = [set(o.split()) for o in TEMPLATES if o != t]
        reach = len(t.split()) + len(t.split()) // 2
        for i in range(len(w)):
            block = set(w[i:i + reach])
            share = len(ts & block)
            if share >= least and all(block & (ts - o) for o in others if len(ts & o) >= least and ts - o):
                found[t] = max(found.get(t, 0), share / len(ts))
    found = {t: x for t, x in found.items() if not any(set(t.split()) < set(o.split()) for o in found)}
    labels = {l for _, l in places} | {TEMPLATES[t] for t in found}
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in places})), ",".join(sorted(labels)),
            max(found.values(), default=0.5 if places else 0.0))


def test_license_brute(spark):
    r = random.Random(8)
    pool = [w for t in TEMPLATES for w in t.split()] + ["MIT License", "mit license mit license", "Apache  License,", "the", "of", "foo"]
    texts = ODD + [t.title() + "." for t in TEMPLATES] + [" ".join(r.choice(pool) for _ in range(40)) for _ in range(40)]
    texts += [" ".join(w for w in t.split() if r.random() > 0.1) for t in TEMPLATES] + ["foo " * 30 + " ".join(r.sample(t.split(), len(t.split()))) for t in TEMPLATES]
    texts += ["foo bar Licensed under the Apache License version.", "All rights RESERVED", "rights reserved", "GNU General Public\nLicense", "MIT \u212aLicense", "Licensed under CC BY-NC 4.0."]
    texts += [texts[-1]] * 2 + ["word " * 200_000 + "released under the MIT license"]
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("w", "found", "labels", "n_words", "base", "ts")})
    got = {x.doc_id: x for x in license_scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, n_base, first, last, base, labels, score = brute_license(t) if len(t or "") < 100_000 else (200_005, 1, 200_003, 200_003, "mit", "mit,mit-notice", 1.0)
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) == (n, n_base, first, last, base, labels), t
        assert abs(g.score - score) < 1e-9, t
    assert license_scan(docs(spark, ["x"]).limit(0)).count() == 0


def test_license_labels_do_not_contradict(spark):
    texts = list(TEMPLATES) + ["Licensed under CC BY-NC 4.0"]
    got = {x.doc_id: x.labels.split(",") for x in license_scan(docs(spark, texts)).collect()}
    for i, name in enumerate(TEMPLATES.values()):
        family = {x for x in got[i] if x.split("-")[0] == name.split("-")[0] and "-" in x and not x.endswith(("notice", "grant"))}
        assert name in got[i] and len(family) <= 1, (name, got[i])
    assert got[len(TEMPLATES)] == ["cc-by-nc-4.0-notice"]


def brute_units(text):
    """(start, end, words) of the units, from the text alone."""
    out, words = [], [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    for i, (s, e) in enumerate(words):
        if not out or text[words[i - 1][1] - 1] in ".!?" or "\n" in text[words[i - 1][1]:s]:
            out.append([s, s, []])
        out[-1][1] = words[i + 1][0] if i + 1 < len(words) else len(text)
        out[-1][2].append("".join(c.lower() if c.isascii() else c for c in text[s:e]))
    return out


def brute_dedup(rows, least):
    """(units, removed units, text) of (doc_id, text) rows in rank order."""
    seen, out = set(), []
    for _, text in rows:
        units, gone = brute_units(text), set()
        for u in range(len(units)):
            n, v = 0, u
            while v < len(units) and n < least:
                n += len(units[v][2])
                v += 1
            if n >= least:
                key = tuple(w for x in units[u:v] for w in x[2])
                gone |= set(range(u, v)) if key in seen else set()
                seen.add(key)
        head = (text or "")[: units[0][0]] if units else text or ""
        out.append((len(units), len(gone), head + "".join(text[s:e] for i, (s, e, _) in enumerate(units) if i not in gone)))
    return out


def told(rows):
    return sorted((r.doc.doc_id is not None, r.doc.doc_id or 0, r.n_units, r.n_removed, r.text or "") for r in rows)


def test_line_dedup_brute(spark):
    r = random.Random(4)
    sentences = [" ".join(r.choice(["a", "B", "cé", "d,"]) for _ in range(r.randrange(1, 7))) + r.choice([".", "!", "", "\n", " ?"]) for _ in range(40)]
    texts = [r.choice(["", "\n ", "  "]) + "".join(r.choice(sentences) + r.choice([" ", "\n", " \n\t"]) for _ in range(r.randrange(30))) for _ in range(80)] + ODD
    texts += ["x. " * 50, texts[0], texts[1].upper(), ". . . ! ?", "\n\n \n", "one long unit without an end " * 9] * 2
    for least in (1, 8, 25):
        got = told(line_dedup(docs(spark, texts), least).collect())
        want = brute_dedup(list(enumerate(texts)), least)
        assert got == sorted((True, i, *x) for i, x in enumerate(want))


def test_line_dedup_offsets_and_columns(spark):
    long = "This line is long enough to be a unit, as it has many more words."
    text = f"à\n  this  LINE is long enough to be a unit, AS it has many more words. \nshort\n{long}"
    df = docs(spark, [f"{long}\nshort\nshort", text, None]).withColumns({c: F.lit(1) for c in ("kept", "n_removed", "d1", "u", "_k", "doc", "gone", "copy", "count")})
    got = {r.doc.doc_id: r for r in line_dedup(df, 8).collect()}
    raw = text.encode()
    assert got[1].text == "à\n  short\n" and [(k.unit, raw[k.start:k.end].decode()) for k in got[1].kept] == [(0, "à\n  "), (2, "short\n")]
    assert got[2].text is None and got[2].n_units == 0 and got[2].kept == [] and got[0].doc.extra == "z" and got[0].doc.kept == 1 and got[0].n_removed == 0
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_repeated_rows_and_null_ids(spark):
    long = "nine words that make one unit of their own. "
    rows = [(7, long * 2), (7, long * 2), (7, long * 2), (None, long + "tail"), (7, "other text of exactly eight words in all."), (7, None), (7, None)]
    got = told(line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect())
    assert [(x[0], x[2], x[3]) for x in got] == [(False, 2, 0), (True, 0, 0), (True, 0, 0), (True, 1, 0), (True, 2, 2), (True, 2, 2), (True, 2, 2)]
    same = spark.createDataFrame([(7, long)] * 3, "doc_id bigint, text string")
    assert sorted(r.n_removed for r in line_dedup(same, 8).collect()) == [0, 1, 1]


def test_line_dedup_very_long_text(spark):
    """A million lines, the second half of which repeats the first; a line that is everywhere."""
    lines = [f"line {i} holds {i * 7} and {i * 11} words of it" for i in range(500_000)]
    df = spark.createDataFrame([(0, "\n".join(lines + lines))] + [(i, "the very same line stands in all of these texts") for i in range(1, 2000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup(df, 9).select("doc.doc_id", "n_units", "n_removed").collect()}
    assert (got[0].n_units, got[0].n_removed) == (1_000_000, 500_000) and got[1].n_removed == 0 and all(got[i].n_removed == 1 for i in range(2, 2000))


def brute_pfair(weights, blocks):
    """Slot by slot, over all sources: the released block that is due first, by exact fractions."""
    total = sum(Fraction(w) for w in weights.values())
    done, out, slot = dict.fromkeys(weights, 0), {}, 0
    while len(out) < sum(blocks[s] for s in weights):
        every = {s: total / Fraction(w) for s, w in weights.items()}
        ready = [(math.ceil((done[s] + 1) * every[s]), str(s), s) for s in weights if done[s] < blocks[s] and math.floor(done[s] * every[s]) <= slot]
        if ready:
            s = min(ready)[2]
            out[s, done[s]] = slot
            done[s] += 1
        slot += 1
    return out


def test_mixing_brute_through_spark(spark):
    r = random.Random(6)
    for weights in ({"a": 5, "b": 1, None: 2}, {"a": 2**0.5, "b": 0.1, None: 1 / 3}, {"a": 1, "b": 0}, None):
        rows = [(i, r.choice("aaaaab"), i) for i in range(900)] + [(i, None, i) for i in range(900, 930)]
        df = spark.createDataFrame(rows, "doc_id bigint, source string, slot bigint").withColumns({c: F.lit(7) for c in ("block", "_s", "s", "k", "at", "doc", "range", "before")})
        got = mix_sources(df, weights=weights, block_rows=4).collect()
        n = Counter(x[1] for x in rows)
        target = {s: w for s, w in ((s, n[s] ** 0.5 if weights is None else weights.get(s, 0)) for s in n) if w}
        want = brute_pfair(target, {s: -(-k // 4) for s, k in n.items()})
        assert len(got) == len(rows) and set(got[0].asDict()) == set(df.columns) | {"src_rank", "block", "slot", "position"}
        for x in got:
            slot = want.get((x.source, x.src_rank // 4))
            assert x.slot == slot and x._s == 7 and x.block == x.src_rank // 4 and x.position == (None if slot is None else 4 * slot + x.src_rank % 4)


def test_lag_at_a_million_slots():
    """Irrational weights over a whole long schedule, against the exact targets."""
    weights = {"a": 2**0.5, "b": 3**0.5, "c": 1.0}
    total = sum(Fraction(w) for w in weights.values())
    placed = place_blocks(weights, {s: int(1_000_000 * Fraction(w) / total) for s, w in weights.items()})
    for s, x in placed.items():
        w = Fraction(weights[s]) / total
        for j in (*range(0, len(x), 997), len(x) - 1):
            assert w * x[j] - j < 1 and j + 1 - w * (x[j] + 1) < 1


def test_blocks_are_bounded():
    assert rows_a_block(1000) == 16 and -(-10**11 // rows_a_block(10**11)) <= 1 << 20


def test_lag_below_one_block_of_the_target_weights(spark):
    """Over a whole skewed schedule, where whole shares would drift away from the weights."""
    weights = {"hot": 3000, **{f"s{i}": 1 for i in range(300)}}
    df = spark.range(60_300).selectExpr("id as doc_id", "if(id < 60000, 'hot', concat('s', id - 60000)) as source")
    total = sum(weights.values())
    for r in mix_sources(df, weights=weights).groupBy("source", "block").agg({"slot": "max"}).collect():
        w, slot = weights[r.source] / total, r[2]
        assert w * slot - r.block < 1  # blocks before the slot
        assert r.block + 1 - w * (slot + 1) < 1


def test_lag_at_every_slot():
    weights, blocks = {"a": 2**0.5, "b": 1, "c": 1e-3, None: 0.3}, {"a": 9000, "b": 200, "c": 5, None: 0}
    placed = place_blocks(weights, blocks)
    total = sum(weights.values())
    assert {s: len(x) for s, x in placed.items()} == blocks
    assert len({t for x in placed.values() for t in x}) == sum(blocks.values())
    for s, x in placed.items():
        for j, t in enumerate(x):
            w = weights[s] / total
            assert w * t - j < 1 and j + 1 - w * (t + 1) < 1


def test_mix_keeps_rows_and_ranks(spark):
    r = random.Random(2)
    rows = [(i, "t", None, r.choice(["a"] * 6 + ["b", None]), None, "z") for i in range(5000)] + [(1, "t", None, "a", None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string")
    got = mix_sources(df).collect()
    assert sorted((x.doc_id, str(x.source)) for x in got) == sorted((x[0], str(x[3])) for x in rows)
    by = defaultdict(list)
    for x in got:
        by[x.source].append(x.src_rank)
        assert x.block == x.src_rank // 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({x.position for x in got}) == len(got)
    assert mix_sources(df.limit(0)).count() == 0


def test_kept_by_the_learned_rules_brute(spark):
    """The query's verdict, from statistics taken and rules applied in Python."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rules = qr.learn(qr.labelled_rows(d, labels), list(qr.FEATURES))
    assert rules
    texts = {r.doc_id: r.text for r in d.collect()}
    dropped = 0
    for r in qr.quality_rules(d, labels).collect():
        t = texts[r.doc_id] or ""
        n, chars, symbols, dup, rep = brute_stats(t)
        w, lines = ws(t), sum(bool(ws(x)) for x in t.split("\n"))
        x = {"symbol_share": symbols / max(chars, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": rep / max(n, 1), "mean_word": chars / max(n, 1),
             "distinct_share": len(set(w)) / max(n, 1), "words_a_line": n / max(lines, 1), "log_words": math.log(n + 1), "stop_share": sum(y.count(".") + y.count(",") for y in w) / max(n, 1)}
        hit = any(all((x[l.feature] >= l.cut) == l.at_least for l in rule) for rule in rules)
        assert r.kept == (not (n < 20 or 100 * rep > 30 * n) and not hit), r
        dropped += hit
    assert dropped
