"""Plain statements of the results the queries must give."""

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text)
           if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text)
            if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text)
            if len(m.group()) >= 24]
    return sorted(out)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int((p.lstrip("0") or "0")[:4]) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def counts(spans, n):
    return tuple(sum(o == i for _, o, _, _ in spans) for i in range(n))


def all_secrets(text):
    """The fixed spans and the weak ones that the secrets of the text take, listed."""
    base = [(s, o, k, e) for s, o, e, k in secret_spans(text)]
    weak = [(m.start(), 3, "key", m.end()) for m in re.finditer(
        r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}", text)
        if all(re.search(c, m.group()) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    weak += [(m.start(), 4, "identifier", m.end()) for m in re.finditer(
        r"""(?i:\b(?:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", text)]
    weak += [(m.start(), 5, "endpoint", m.end()) for m in re.finditer(
        r"\bhttps?://[^\s\"'<>,]+", text)]
    every = sorted(base + [x for x in weak if not any(y[0] < x[3] and y[3] > x[0] for y in base)])
    gaps = [text[every[i - 1][3] if i else 0:x[0]] for i, x in enumerate(every)]
    ends = [(bool(re.search(r"\n[ \t\r]*\n|[{}]", g)),
             bool(re.search(r"\n[ \t\r]*\n {0,3}#{1,6} |\n {0,3}\[[^\]\n]{1,80}\][ \t\r]*\n"
                            r"|\n(?:-{3,}|={3,}|\*{3,})[ \t\r]*\n", g))) for g in gaps]
    out = set(base)
    for i, x in enumerate(every):
        if x[2] not in ("assign", "hex", "key"):
            continue
        best = {}
        for j, y in enumerate(every):
            role = {"access": "identifier"}.get(y[2], y[2])
            if j == i or role not in ("identifier", "endpoint"):
                continue
            between = ends[min(i, j) + 1:max(i, j) + 1]
            scope = 2 if any(b[1] for b in between) else int(any(b[0] for b in between))
            rank = (scope, max(0, (x[0] - y[3]) if j < i else (y[0] - x[3])), y)
            best[role] = min(best.get(role, rank), rank)
        if best:
            out.add(x)
        if "identifier" in best:
            out |= {r[2] for r in best.values()}
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))
