"""Brute-force versions that the operators are compared with."""

import html
import math
import re
from collections import defaultdict

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")

#: Rows with nulls, ties, empty and very long texts, and repeats; columns with names that operators use, too.
AWKWARD_SCHEMA = "doc_id long, text string, lang string, source string, `key` int, `__text` string, `__gone` int, `__source` string, `id` int, `part` int, shard_id int, item_id long"


def awkward(texts):
    """Rows of AWKWARD_SCHEMA of (doc_id, text) and the awkward ones."""
    rows = [(i, t, "en" if i is None or i % 2 else "de", None if i is None or i % 5 == 0 else f"s{i % 3}", 1, "x", 2, "y", 3, 4, 5, 6) for i, t in texts]
    long_text = " ".join(f"lang{i % 977} wort{i % 13}" for i in range(60_000))
    extra = [(None, "a text without an id"), (900, None), (901, ""), (902, "   \n\t "), (903, "!!! ???"), (904, long_text), (905, "one"), (906, "one"), (906, "one")]
    return rows + [(i, t, None, "s9", None, None, None, None, None, None, None, None) for i, t in extra]


def lowered(text):
    return (text or "").lower().replace("\u03c2", "\u03c3").replace("i\u0307", "i")


def words(text):
    return WORD.findall(lowered(text))


def repeated_spans(rows, length, later_only):
    """(doc_id, start_word, end_word, first_doc) of every row's repeated windows."""
    docs = [(i, words(t)) for i, t in rows if i is not None]
    holders = defaultdict(set)
    for i, w in docs:
        for p in range(len(w) - length + 1):
            holders[tuple(w[p : p + length])].add(i)
    out = []
    for i, w in docs:
        spans = []
        for p in range(len(w) - length + 1):
            own = holders[tuple(w[p : p + length])]
            if len(own) > 1 and (not later_only or min(own) < i):
                if spans and p <= spans[-1][1]:
                    spans[-1] = [spans[-1][0], p + length, min(spans[-1][2], min(own))]
                else:
                    spans.append([p, p + length, min(own)])
        out += [(i, a, b, f) for a, b, f in spans]
    return sorted(out)


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(pairs):
    """Connected components: member -> smallest member, of all members."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def near_groups(rows, k, threshold):
    """doc_id -> keep_id of near-duplicate groups by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    sets = [(i, s) for i, s in sets if s]
    pairs = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i != j and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                same = len(a & b)
                if same >= threshold * (len(a) + len(b) - same):
                    pairs.append((i, j))
    return groups(pairs)


def contained(rows, items, k, threshold):
    """(doc_id, item_id, containment) by looking for each gram of each item in each document.

    An item's grams are its runs of k words, or all its words if it has fewer; the
    containment is the share of its distinct grams that occur as runs of words of the
    document, and of an id with several texts the largest one.
    """
    best = {}
    texts = [(n, d, f" {' '.join(words(t))} ") for n, (d, t) in enumerate(rows)]
    for i, it in items:
        w = words(it)
        if i is None or not w:
            continue
        size = min(k, len(w))
        grams = {" ".join(w[p : p + size]) for p in range(len(w) - size + 1)}
        for n, d, text in texts:
            c = sum(f" {g} " in text for g in grams) / len(grams)
            if c >= threshold:
                best[n, d, i] = max(round(c, 6), best.get((n, d, i), 0.0))
    return sorted(((d, i, c) for (_, d, i), c in best.items()), key=str)


def fair_queue(rows, weights, share, key):
    """Served (doc_id, source, n_tokens) in order: rows are (doc_id, text, source)."""
    size = lambda t: len(re.findall("[^ \t\n\r\f]+", t or ""))
    flows = defaultdict(list)
    for d, t, s in rows:
        flows[s].append((key(d), d is not None, d or 0, d, size(t)))
    stream = []
    for s, docs in flows.items():
        run = 0
        for k, _, _, d, n in sorted(docs, key=lambda x: x[:3]):
            run += n
            stream.append((run / weights.get(s, 1.0), s is not None, s or "", k, d is not None, d or 0, n, d, s))
    budget, run, out = int(sum(x[6] for x in stream) * share), 0, []
    for x in sorted(stream, key=lambda x: x[:6]):
        run += x[6]
        if run <= budget:
            out.append((x[7], x[8], x[6], run))
    return out


def least_capacity(sizes, n):
    """The smallest largest shard, by dynamic programming over all cuts."""
    run = [0]
    for s in sizes:
        run.append(run[-1] + s)
    best = run[:]
    for _ in range(n - 1):
        best = [min((max(best[j], run[i] - run[j]) for j in range(i + 1)), default=0) for i in range(len(run))]
    return best[-1]


def html_content(page, sigma, block, hidden):
    """(content, content lines, lines with text) of a well-formed page."""
    lines, parts, tags, depth = [], [], 0, []

    def end():
        nonlocal parts, tags
        text = " ".join("".join(parts).split())
        if text or tags:
            lines.append((text, tags))
        parts, tags = [], 0

    for part in re.split(r"(<!--.*?-->|<![^>]*>|<script.*?</script>|<style.*?</style>|<[^>]*>)", page or "", flags=re.S):
        if part.startswith("<!"):
            continue
        name = re.match(r"</?([a-zA-Z0-9]+)", part)
        if part.startswith("<script") or part.startswith("<style"):
            tags += 2
        elif name and part.endswith(">"):
            tag, closes = name.group(1).lower(), part.startswith("</")
            if closes:
                if tag in depth:
                    depth.remove(tag)
                tags += 1
                if tag in block:
                    end()
            else:
                if tag in hidden:
                    depth.append(tag)
                if tag in block:
                    end()
                tags += 1
        elif not depth:
            first, *rest = html.unescape(part).split("\n")
            parts.append(first)
            for x in rest:
                end()
                parts.append(x)
    end()
    chars = [len(t) for t, _ in lines]
    if not any(chars):
        return "", 0, 0
    raw = [math.log1p(len(t) / max(n, 1)) for t, n in lines]
    far = math.ceil(3 * sigma)
    smooth = []
    for i in range(len(raw)):
        near = [(math.exp(-0.5 * ((i - j) / sigma) ** 2), raw[j]) for j in range(len(raw)) if abs(i - j) <= far]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    order, best, cut = sorted(smooth), None, 0.0
    spread = lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for x in xs)
    for i in range(1, len(order)):
        if order[i] != order[i - 1]:
            cost = spread(order[:i]) + spread(order[i:])
            if best is None or cost < best - 1e-12:
                best, cut = cost, (order[i - 1] + order[i]) / 2
    kept = [t for (t, _), x in zip(lines, smooth) if t and x >= cut]
    return "\n".join(kept), len(kept), sum(c > 0 for c in chars)


def language(text, model):
    """(language, gap) by the definition: every gram of the text, every bit, every codeword."""
    code = lambda b: b - 96 if 97 <= b < 123 else b - 64 if 65 <= b < 91 else 27 + (b - 128) % 37 if b >= 128 else 0
    codes = []
    for b in lowered(text).encode():
        c = code(b)
        if c or not codes or codes[-1]:
            codes.append(c)
    if not any(codes) or not model.langs:
        return "und", 0.0
    n = len(codes)
    margins = []
    for w in model.weights:
        total = 0.0
        for i, a in enumerate(codes):
            b = codes[i + 1] if i + 1 < n else 0
            c = codes[i + 2] if i + 2 < n else 0
            total += float(w[a]) + float(w[64 + a * 64 + b]) + float(w[64 + 4096 + (a * 64 + b) * 64 + c])
        margins.append(total / n * min(n, 180) / 6)
    loss = [sum(al * math.log1p(math.exp(-m * x)) for m, x, al in zip(margins, word, model.alphas)) for word in model.codes]
    order = sorted(range(len(loss)), key=lambda k: loss[k])
    return model.langs[order[0]], loss[order[1]] - loss[order[0]] if len(loss) > 1 else math.inf
