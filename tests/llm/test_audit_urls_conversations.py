"""Filter audit, URL filters and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tracklake.llm import conversation_repair, filter_audit, url_filters

SPACE = r"[\x20\x09-\x0D]"


# filter audit
def failing(text, smaller_copy):
    t = text or ""
    ws = [w for w in re.split(SPACE + "+", t) if w]
    tests = (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller_copy)
    return {name for name, fails in zip("ABCDE", tests, strict=True) if fails}


def audited(docs, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((lang or "", failing(text, copy), i in good, i in toxic))
    out, value = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in mine if f in r[1] and not before & r[1]]
                value[part, f] = value.get((part, f), 0) + len(here)
                out[part, order, step] = [
                    sum(not (before | {f}) & r[1] for r in mine), len(here), sum(f in r[1] and bool(before & r[1]) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
    return {k: tuple([*v, value[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def made_docs():
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rnd.randrange(rnd.choice((30, 400)))}" for _ in range(rnd.choice((3, 90, 100, 150)))]
        text = rnd.choice((" ", "\n")).join(words)
        text = text.upper() if rnd.random() < 0.2 else text
        texts.append(text + rnd.choice(("", "", " #", " $ |")))
    texts += [rnd.choice(texts) for _ in range(40)] + [None, "", "", "long " * 20_000]
    docs = [(i, t, rnd.choice(("en", "de", None, ""))) for i, t in enumerate(texts)]
    docs += [(7, docs[7][1], "en"), (7, "another text of an id that is there twice", None), (None, docs[3][1], "de"), (None, docs[3][1], "de"), (None, None, None)]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1))) for i in range(0, 100, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = made_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(df, marks)
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in out.collect()}
    assert got == audited(docs, labels)
    assert filter_audit.filter_audit(df.limit(0), marks).count() == 0
    bare = filter_audit.filter_audit(df, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


def test_lattice_counts_all_orders():
    for k in range(1, 6):
        forward, backward = filter_audit.lattice(k)
        for s in range(1 << k):
            n = s.bit_count()
            assert (forward[s], backward[s]) == (math.factorial(n), math.factorial(k - n))
        through = [0] * k
        for _, f, n in filter_audit.all_edges(k):
            through[f] += n
        assert through == [math.factorial(k)] * k


def test_audit_of_own_filters(spark):
    df = spark.range(100)
    counts = filter_audit.set_counts(df, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0, "z": F.lit(None).cast("boolean")}, F.lit("all"), {"low": F.col("id") < 10})
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(counts, "xyz", ("low",)).collect()}
    assert len(rows) == 18
    assert (rows["xyz", 1]["removed"], rows["xyz", 2]["removed"], rows["yxz", 2]["removed"], rows["xyz", 2]["redundant"], rows["xyz", 2]["kept"]) == (50, 17, 33, 17, 33)
    assert (rows["xyz", 1]["lost_low"], rows["xyz", 1]["unique_fails"], rows["xyz", 3]["shapley"]) == (5, 33, 0)
    assert rows["xyz", 1]["shapley"] == 3 * 50 + 3 * 33
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "xx")


# URL filters
RULES = [url_filters.Rule("block", "net", "/"), url_filters.Rule("allow", "example.net", "/en/"), url_filters.Rule("block", "example.com", "/de/"), url_filters.Rule("allow", "org", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0]
    rest = url.split("://", 1)[1][len(host) :]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest)[0]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://example.net/EN/", "http://net/", "http://xnet/", "http://a.net", "http://a.net?x=1", "http://É.org/fr/é#f", "a://b://c.org/fr/", "http://org/fr", "http://sub.example.com/de/?a=1&b=2", "http://x.com/" + "7" * 50_000, "http://a.org/fr/\nx"]


def made_urls(n=3000, seed=2):
    """Urls of rules' hosts, and of others: blocked ones are long and full of digits, in all of them."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rnd.random() < 0.5
        site = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4, 9)))
        path = "".join(rnd.choice("0123456789" if bad else "klmnop") for _ in range(rnd.randrange(20, 40) if bad else rnd.randrange(3, 12)))
        host = rnd.choice((f"{site}.example.net", f"{site}.info")) if bad else rnd.choice((f"{site}.org", f"{site}.info"))
        out.append((bad, f"https://{host}/{'xx' if bad else 'fr'}/{path}{'?a=1&b=2&c=3' if bad and rnd.random() < 0.5 else ''}"))
    return out


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "own", 1.0) for i, u in enumerate(ODD * 2)], "page_id long, url string, host string, score double")
    rows = url_filters.url_filter(df, RULES).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        host, path = split(ODD[r["page_id"] % len(ODD)])
        rule = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.host + rule.path)
        assert r["verdict"] == (rule.action if rule else ("block" if r["score"] > 0.5 else "allow"))
    assert url_filters.url_filter(df.limit(0), RULES).count() == 0
    one_kind = url_filters.url_filter(df, RULES[:1]).select("score").distinct().collect()
    assert len(one_kind) == 1 and one_kind[0]["score"] > 0.5


def test_url_trees_learn_what_rules_show(spark):
    urls = made_urls()
    df = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(urls)], "page_id long, url string").repartition(4)
    out = {r["page_id"]: r for r in url_filters.url_filter(df, RULES).collect()}
    unknown = [i for i, (_, u) in enumerate(urls) if ".info/" in u]
    assert len(unknown) > 1000 and all(out[i]["rule"] is None for i in unknown)
    right = sum((out[i]["verdict"] == "block") == urls[i][0] for i in unknown)
    assert right > 0.97 * len(unknown)
    few = {r["page_id"]: r["verdict"] for r in url_filters.url_filter(df, RULES, most_rows=300).collect()}
    assert sum((few[i] == "block") == urls[i][0] for i in unknown) > 0.9 * len(unknown)


def test_entropy(spark):
    texts = ["", "aaaa", "abab", "abcd", "aabbbc", "é漢é"]
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    got = [r["e"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("e", url_filters.entropy(F.col("t"))).orderBy("i").collect()]
    assert got == pytest.approx(want)


def boosted(examples, trees, depth):
    """The same trees from plain loops over every example, split and leaf."""
    n, blocked = (sum(e[k] for e in examples) for k in (1, 2))
    base, grown = math.log((blocked + 1) / (n - blocked + 1)), []
    place = lambda x, fs, cs: sum((x[f] > c) << (len(fs) - 1 - k) for k, (f, c) in enumerate(zip(fs, cs, strict=True)))
    for _ in range(trees):
        p = [1 / (1 + math.exp(-(base + sum(t[2][place(x, t[0], t[1])] for t in grown)))) for x, _, _ in examples]
        grads = [(x, round((b - m * q) * 1e6) / 1e6, round(m * q * (1 - q) * 1e6) / 1e6) for (x, m, b), q in zip(examples, p, strict=True)]
        fs, cs = [], []
        for _ in range(depth):
            def gain(f, c):
                sums = {}
                for x, g, h in grads:
                    for key in ((place(x, fs, cs), x[f] > c), (place(x, fs, cs), None)):
                        a = sums.setdefault(key, [0.0, 0.0])
                        a[0] += g
                        a[1] += h
                return sum((1 if side is not None else -1) * g * g / (h + 1) for (_, side), (g, h) in sums.items())

            best, top = None, 0.0
            for f in range(len(examples[0][0])):
                for c in range(url_filters.BINS - 1):
                    if gain(f, c) > top + 1e-9:
                        best, top = (f, c), gain(f, c)
            if best is None:
                break
            fs.append(best[0])
            cs.append(best[1])
        leaves = [[0.0, 0.0] for _ in range(1 << len(fs))]
        for x, g, h in grads:
            leaves[place(x, fs, cs)][0] += g
            leaves[place(x, fs, cs)][1] += h
        grown.append((fs, cs, [url_filters.RATE * g / (h + 1) for g, h in leaves]))
    return base, grown


def test_boosting_equals_plain_loops(spark):
    rnd = random.Random(3)
    examples = []
    for _ in range(25):
        x = [rnd.randrange(0, 6) for _ in url_filters.FEATURES]
        n = rnd.randrange(1, 9)
        examples.append((x, n, sum(rnd.random() < (0.9 if x[0] > 2 and x[4] < 3 else 0.2) for _ in range(n))))
    model = url_filters.boost(spark.createDataFrame(examples, "x array<int>, n long, blocked long"), 2, 3)
    base, trees = boosted(examples, 2, 3)
    assert model.base == pytest.approx(base)
    assert [(t.features, t.cuts) for t in model.trees] == [(f, c) for f, c, _ in trees]
    for mine, theirs in zip(model.trees, trees, strict=True):
        assert mine.leaves == pytest.approx(theirs[2], abs=1e-5)


# conversation repair
def cheapest(codes):
    """(cost, letters) by dynamic programming over suffixes; d is a message that must go."""
    moves, wanted = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (2, 2, 3, 2)
    after = [(0, ""), None, None, (0, "")]
    for i in range(len(codes), -1, -1):
        here = [None] * 4
        for q in range(4):
            if i == len(codes):
                here[q] = after[q]
                continue
            c, t = codes[i].lower(), codes[i].isupper()
            ways = [(3, "D", after[q])]
            if c != "d":
                ways += [(2 + t, "R", after[wanted[q]])] + ([(int(t), "K", after[moves[q, c]])] if (q, c) in moves else [])
            here[q] = min(((cost + a[0], x + a[1]) for cost, x, a in ways if a), default=None)
        for _ in range(4):
            here = [min((x for x in (here[q], here[wanted[q]] and (2 + here[wanted[q]][0], "I" + here[wanted[q]][1])) if x), default=None) for q in range(4)]
        after = here
    return after[0]


def test_auction_finds_the_least_of_the_cheapest_edits(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("suaxSUAXuauaua") for _ in range(rnd.randrange(0, 9))) for _ in range(1500)]
    for block in (64, 3, 2):
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
        memory = {}
        for codes in texts:
            letters, cost = conversation_repair.edits(codes, memory)
            assert (cost, letters) == cheapest(codes), codes
    monkeypatch.setattr(conversation_repair, "BLOCK", 64)
    for n in (64, 65, 700, 5000):
        codes = "".join(rnd.choice("uauauauauaUAsx") for _ in range(n))
        letters, cost = conversation_repair.edits(codes, {})
        assert (cost, letters) == cheapest(codes)


def plain_repair(rows):
    """Contract of repair over (turn, role, text) of one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
    turns = {t for t, _, _ in rows if t is not None}
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, r, x in rows:
        bare = x.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((r, x))
        if fault:
            faults[fault] += 1
        code = r[0] if r[:1] in ("s", "u", "a") and r else "x"
        codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
    cost, letters = cheapest(codes)
    out, q, k = [], 0, 0
    moves, wanted, roles = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (2, 2, 3, 2), ("user", "user", "assistant", "user")
    for x in letters:
        role, text = rows[k][1:] if k < len(rows) else ("", "")
        if x in "RI":
            out.append((x, roles[q], "" if x == "I" else text))
            q = wanted[q]
        elif x == "K":
            out.append((x, role, text))
            q = moves[q, role[0]]
        k += x != "I"
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in out).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, letters, digest), out


def made_conversations():
    """Turns may be null and repeated; messages of one turn have different roles or are equal, so that their order is given."""
    rnd = random.Random(6)
    out = {}
    for conv in [None, *range(40), 99]:
        rows = []
        for i in range(300 if conv == 99 else rnd.randrange(1, 12)):
            role = rnd.choice(("user", "assistant")) if rnd.random() < 0.3 else ("user", "assistant")[i % 2]
            role = rnd.choice(("system", "tool", "", None)) if rnd.random() < 0.12 else role
            text = rnd.choice((f"Say {i}.", f"Say {i}!", f"Say {i}", "Again.", "Again?\n", " \t", "", None, "Ünd 漢.", "x " * 3000 + "."))
            turn = None if i == 0 and rnd.random() < 0.3 else i + (i > 3)
            rows += [(turn, role, text)] * rnd.choice((1, 1, 1, 1, 2, 3))
            if rnd.random() < 0.1:
                rows.append((turn, "zzz", "Other role."))
        out[conv] = rows
    out[100] = [(None, "user", "Hi."), (None, "user", "Hi."), (None, None, None)]
    return out


@pytest.mark.parametrize("piece", [512, 4])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    convs = made_conversations()
    rows = [(c, *m, "x", 1) for c, ms in convs.items() for m in ms]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string, n int").repartition(5)
    want = {c: plain_repair(ms) for c, ms in convs.items()}
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df).collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c][0], c
    told = {}
    for r in conversation_repair.repaired(df).orderBy("conv_id", "place").collect():
        told.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert told == {c: out for c, (_, out) in want.items() if out}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(empty).count() == 0
    assert conversation_repair.repaired(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(5)] + [(None, None, None, None), (3, None, None, "a?")]
    want = []
    for c, t, r, x in rows:
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if m == 1 else re.sub("[.!?]", "", x) if m == 2 else x
        want += [(c, t, "user" if m == 4 else r, x)] * (0 if m == 0 else 2 if m == 3 else 1)
    got = [tuple(r) for r in conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
