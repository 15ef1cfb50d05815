"""Plain Python versions of what the operators compute."""

import hashlib
import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """Rows of (id, text): each row's (set size, least id reachable)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def contamination(texts, items):
    """For each text (n_words, n_hit, n_items, items_sha256)."""
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii(text):
    out = []
    for kind, p in PII:
        if kind == "email" and "@" not in (text or ""):  # the plain pattern takes a quadratic time over a long run of letters
            continue
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def resampled(docs, target, buckets=10_000, seed=7, share=25, least=20):
    """For rows (id, text): {id: (n_features, weight, score, rank)}."""
    import math
    import zlib
    from collections import Counter

    def features(text):
        w = [x.decode() for x in words(text)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in w + [" ".join(p) for p in zip(w, w[1:])]]

    own = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for k, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None])
        if n >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(fit[: share * len(fit) // 100]):
        row[4] = place + 1
    return sorted(map(tuple, out), key=str)


def variants(docs, least=7, often=2, deleted=31, times=10):
    """For rows (id, text): {word: (form, root, n, n_near, form_n)}."""
    import zlib
    from collections import Counter

    counts = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % deleted == 0 else w
            counts[w] += len(w) >= least
    n = {w: c for w, c in counts.items() if c >= often}
    near, gaps = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    for (_, rest), group in gaps.items():
        for w in group:
            near[w] |= group - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(s, key=lambda x: (-n[x], x)) for w, s in near.items() if s}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def shared_out(sizes, weights=(3, 1, 2), share=150, most=2):
    """Targets of sources from their words, in code-point order, null last; excess goes round until none is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, rest, out = set(order), sum(sizes.values()) * share / 100, {}
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / whole >= most * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            free.discard(s)
    return out | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
