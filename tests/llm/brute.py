"""Plain versions of the corpus operators over a few texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np

from tracklake.llm.simhash import fingerprint

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, personal data, secrets, blanks and nulls; doc_id -> text."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 4 + [rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") + rnd.choice(["n", "r", "st", "lé", "ing"]) + str(i % 7 or "") for i in range(90)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [say(40), say(60)]
    out = []
    for i in range(n):
        kind = rnd.randrange(8)
        text = say(rnd.randrange(5, 150))
        if kind == 0 and out:
            text = rnd.choice(out) or ""
        elif kind == 1 and out and out[-1]:
            ws = out[-1].split(" ")
            ws[rnd.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        elif kind == 2:
            text = f"{text} {rnd.choice(shared)}\n{text[:40]}"
        elif kind == 3:
            text = f'{text} mail me.{i % 3}@ex.org or +1 (555) 123-4567 ip 10.0.0.{i} card 4111 1111 1111 1111 user: bob{i} {text}'
        elif kind == 4:
            text = f'{text} password = "hunter{i}222" AKIA{"ABCDEFGH1234567890"} {"0a1b" * 8} https://ex.org/{i} login: ann{i} k9ZzQ1x7Lm3Pw8Rt5 {text}'
        out.append(text)
    out[3], out[7], out[11] = None, "", " \n\t "
    return dict(enumerate(out))


def repeats(docs, span=20):
    first, out = {}, {}
    for i in sorted(docs):
        ws, gone = words(docs[i]), set()
        for p in range(len(ws) - span + 1):
            if first.setdefault(tuple(ws[p : p + span]), (i, p)) != (i, p):
                gone |= set(range(p, p + span))
        out[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    return out


def contamination(docs, items, span=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items.items():
        ws = find(t)
        n = min(span, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[p : p + n]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        ws, hit, ids = find(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(ws) - n + 1):
                if (k := tuple(ws[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[k]
        out[i] = (len(ws), len(hit), sorted(ids))
    return out


def components(docs):
    ids = sorted(docs)
    prints = np.array([fingerprint(docs[i]) for i in ids], np.int64).view(np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for b in range(a):
            if int(prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(i), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def simhash(text):
    """Bit by bit, for comparison with the vectorised one."""
    import xxhash

    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def base_counts(text):
    ws, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + d for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    t = t or ""
    rows = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    rows += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    rows += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    rows += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, s, e) for s, _, e, k in sorted(rows)]


def disclosing_terms(texts, threshold=0.9, support=2, group_support=5):
    """Words that disclose a value or its group, from counts of different texts."""
    rows = []
    for t in {t or "" for t in texts}:
        found = personal(t)
        chars, entities = list(t), set()
        for k, s, e in found:
            v = t[s:e].lower()
            d = re.sub("[^0-9]", "", v)
            entities |= {("=", k, v), ("~", k, {"email": v.split("@")[-1], "ip": v.rpartition(".")[0], "card": d[:6], "phone": d[:-7]}[k])}
            chars[s:e] = " " * (e - s)
        rows.append((entities, set(re.findall(r"[^\W\d_]+", "".join(chars).lower()))))
    n_t, n_e, n_te = Counter(w for _, ws in rows for w in ws), Counter(x for es, _ in rows for x in es), Counter((x, w) for es, ws in rows for x in es for w in ws)
    out = set()
    for (x, w), n in n_te.items():
        ic = np.log2(len(rows) / n_e[x])
        chance = n_t[w] * n_e[x] / len(rows)
        if n >= (support if x[0] == "=" else group_support) and ic >= 3 and ic + np.log2(n / n_t[w]) >= threshold * ic and n - chance >= 3 * chance**0.5:
            out.add(w)
    return out


def secrets(t):
    t = t or ""
    rows = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I) if len(m[2]) >= 6]
    rows += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    rows += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(rows)]


def linked_secrets(t, scope=200):
    """Base spans, and weak parts with a part of every role they need, of other characters, that starts within scope."""
    t = t or ""
    base = secrets(t)
    finds = {
        "client": (r"""(?ai)(?:user(?:_?name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?(?!https?:)[A-Za-z0-9@._-]{3,}""", "id"),
        "mailbox": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "id"),
        "endpoint": (r"""https?://[^\s"'<>|]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""", "endpoint"),
        "opaque": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", "secret"),
    }
    used, chosen = set(), []
    for kind, role in (("access", "id"), ("assign", "secret"), ("hex", "secret")):
        for k, s, e in base:
            if k == kind and not used & set(range(s, e)):
                chosen.append((k, s, e, role))
        used |= {i for k, s, e in base if k == kind for i in range(s, e)}
    for kind, (pattern, role) in finds.items():
        mine = [m for m in re.finditer(pattern, t) if not used & set(range(*m.span()))]
        if kind == "opaque":
            bits = lambda x: -sum(n / len(x) * np.log2(n / len(x)) for n in Counter(x).values())
            mine = [m for m in mine if bits(m[0]) >= 3 and re.search("[0-9]", m[0]) and any(c.isalpha() for c in m[0])]
        chosen += [(kind, *m.span(), role) for m in mine]
        used |= {i for m in mine for i in range(*m.span())}
    out = list(base)
    for kind, s, e, role in chosen:
        near = {r for _, s2, _, r in chosen if abs(s2 - s) <= scope}
        needs = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[role]
        if kind in finds and needs <= near:
            out.append((kind, s, e))
    order = ["assign", "access", "hex", "client", "opaque", "endpoint", "mailbox"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
