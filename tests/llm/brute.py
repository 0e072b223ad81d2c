"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, radius=2, size=3):
    prints = {d: simhash(t, size) for d, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    up = roots(ids, pairs)
    return {d: (f"{prints[d]:016x}", up[d]) for d in ids}


def decontaminate(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(window, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


KINDS = {
    "assign": (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 20),
    "hex": (r"[0-9a-f]+", 0, 0, 24),
}


def base_secrets(text):
    out = []
    for rank, (kind, (rx, flags, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(rx, text or "", flags) if len(m[group]) >= least]
    return sorted(out)


WEAK = {
    "bare": (r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", 0),
    "named": (r"""(?:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.I | re.A),
    "endpoint": (r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0),
}


def linked_secrets(text, reach=400):
    """Base spans, and weak ones outside them with all their complements near."""
    base = base_secrets(text)
    weak = [(m.start(), 3 + k, m.end(), kind) for k, (kind, (rx, flags)) in enumerate(WEAK.items()) for m in re.finditer(rx, text or "", flags)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    roles = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "identifier", "named": "identifier", "endpoint": "endpoint"}
    needs = {"secret": {"identifier"}, "identifier": {"secret"}, "endpoint": {"identifier", "secret"}}
    near = lambda w: {roles[x[3]] for x in base + weak if abs(x[0] - w[0]) <= reach}
    return sorted(base + [w for w in weak if needs[roles[w[3]]] <= near(w)])


def blocked_hosts(pages, z=1.645, above=0.5):
    """Hosts whose posterior bound is over the limit: beta priors from all to suffix to domain to host."""
    two = {"ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk"}
    seen = defaultdict(list)
    for url, html in pages:
        words = len(re.findall(r"[^\x20\x09-\x0D<>]+", html or ""))
        host = url_rule(url, [])[0]
        if words and host:
            seen[host].append(10 * len(re.findall(r"[#*$%&|!]{2,}", html)) > words)

    def of(host, labels):
        last = host.split(".")[-2:]
        return ".".join(host.split(".")[-(labels + (".".join(last) in two)) :])

    levels = [lambda h: of(h, 1), lambda h: of(h, 2), lambda h: h]
    mean = lambda key: (sum(map(sum, seen.values())) + 0.5) / (sum(map(len, seen.values())) + 1)
    for level in levels:
        sums = defaultdict(lambda: [0, 0, 0.0])
        for host, bad in seen.items():
            s = sums[level(host)]
            s[0], s[1], s[2] = s[0] + len(bad), s[1] + sum(bad), mean(host)
        spread = sum(n * (b / n - m) ** 2 for n, b, m in sums.values())
        noise, scale = sum(m * (1 - m) for n, b, m in sums.values()), sum(n * m * (1 - m) for n, b, m in sums.values())
        excess = (spread - noise) / max(scale - noise, 1e-9)
        strength = min(1000.0, max(2.0, 1 / max(excess, 1e-6) - 1))
        post = {k: (strength * m + b, strength * (1 - m) + n - b) for k, (n, b, m) in sums.items()}
        mean = lambda host, level=level, post=post: post[level(host)][0] / sum(post[level(host)])
    out = set()
    for host, (a, b) in post.items():
        m = a / (a + b)
        if m - z * (m * (1 - m) / (a + b + 1)) ** 0.5 > above:
            out.add(host)
    return out


M64 = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def shape(word):
    out = 0
    for b in word.encode():
        c = chr(b)
        out |= 64 if b >= 128 else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if c.isdigit() else 16 if c == "!" else 32 if c in "#*$%&|<>" else 8
    return out


def features(text, bits):
    """(counts of the places, weight)"""
    out, before, shaped = Counter(), 0, 256
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for k, w in enumerate(words):
        word = mix(sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i, b in enumerate(w.translate(LOWER).encode())) & M64)
        form = shape(w) | (128 if k and word == before else 0)
        for h in (word, mix((before + 3 * word) & M64), mix((form + (1 << 20)) & M64), mix((form * 512 + shaped + (1 << 40)) & M64)):
            out[h >> (64 - bits)] += 1
        before, shaped = word, form
    return out, len(words) ** -0.5 if words else 0.0


def ftrl(examples, epochs, alpha=0.5, beta=1.0, l1=0.02, l2=1.0):
    """Weights by place; examples: ({place: value}, label)."""
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for x, label in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    again = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def warc(pages):
    groups = defaultdict(list)
    for page, html in pages:
        groups[html or ""].append(page)
    out = {}
    for html, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        for p in ids:
            out[p] = (len(html.encode()), digest, "response" if p == max(ids) else "revisit", None if p == max(ids) else max(ids))
    return out


def tokens(tokenizer, text, end=1):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))
