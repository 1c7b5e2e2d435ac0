"""Plain Python versions of the operators, to hold their results against."""

from __future__ import annotations

import hashlib
import re

from xxhash import xxh64_intdigest

RULES = [("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
VERDICTS = ["allow", "block", "allow", "block", "block"]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def url_verdict(url, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for (rule_host, start), verdict in zip(RULES, VERDICTS, strict=True):
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(start):
            found = (len(rule_host), len(start), rule_host + start, verdict)
            best = max(best, found) if best else found
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(text)).encode()).hexdigest()


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, links):
    """The smallest id that each reaches."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited(rows):
    """(doc_id, text, edited text, next text) in descending doc_id."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = []
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        out.append((d, text, text[: len(text) - half] + after[:half], after))
    return out


def paragraphs(text):
    return set(text.replace(". ", ".\n").split("\n"))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b)
