"""Brute-force versions of the operators, in plain Python over lists of (doc_id, text)."""

import datetime
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

MASK = (1 << 64) - 1
UP = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(docs, min_docs=10, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    seen = Counter(k for _, k in {(("row", at) if i is None else ("id", i), key(x)) for at, (i, ls) in enumerate(split) for x in ls} if len(k) >= min_chars)
    out = []
    for i, ls in split:
        kept = [x for x in ls if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def copies(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    smallest = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    out = []
    for i, t in docs:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        out.append((i, smallest[n], len(groups[n]), i == smallest[n], sha(n)))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(UP))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(docs, percent=75):
    """doc_id: (n_shingles, component_id) of documents with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}
    posted = defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in posted[g]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            posted[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UP))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            grams[tuple(w[k : k + size])].add(item if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(UP)), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if names := grams.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found - {None}) + [None] * (None in found)))
    return out


def repeats(docs, window=20):
    """Documents with distinct ids, in order of them."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone |= set(range(k, k + window))
            seen.add(g)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def secrets(text):
    """Base spans as (start, kind, end)."""
    found, kinds = [], ("assign", "access", "hex")
    patterns = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for kind, pattern, group, least in zip(kinds, patterns, (2, 0, 0), (6, 20, 24), strict=True):
        found += [(m.start(), kinds.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x for _, _, x in sorted(found)]


def _parsed(text):
    """(own text, units, quoted passages as (level, lines))."""
    marked = []
    for line in (text or "").split("\n"):
        m = re.match(r"[ \t]{0,3}>", line)
        level, rest = 0, line
        if m:
            rest = line.lstrip(" \t")
            while rest.startswith(">"):
                level, rest = level + 1, rest[1:]
                if rest[:1] in (" ", "\t"):
                    rest = rest[1:]
        marked.append([level, rest])
    for i, (level, line) in enumerate(marked):
        told = re.fullmatch(r"(On|Am|Le|El)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*", line.strip())
        rest = [x for x in marked[i + 1 :] if x[0] != 0 or x[1].strip()]
        if level == 0 and told and rest and rest[0][0] > 0:
            marked[i][0] = -1
    passages = []
    for i, (level, line) in enumerate(marked):
        if level > 0 and i and marked[i - 1][0] == level:
            passages[-1][1].append(line)
        elif level > 0:
            passages.append((level, [line]))
    own = "\n".join(x for level, x in marked if level == 0).strip("\n") if passages else text or ""
    units = {squeeze(own), *(squeeze(x) for x in re.split(r"\n[ \t]*\n", own)), *(squeeze(x) for x in own.split("\n"))}
    return own, units - {""}, [(level, lines) for level, lines in passages if squeeze("\n".join(lines))]


def squeeze(text):
    return " ".join(WORD.findall(text)).translate(UP)


def replies(rows):
    """{(conv, turn, role, text): (own text, reply_to, sources, branch, place in reply order)} for rows with distinct (conv, turn)
    and no nulls; sources are (passage, level, conv, turn)."""
    parsed = {(c, t): _parsed(text) for c, t, _, text in rows}
    out = {}
    for conv in {c for c, _ in parsed}:
        turns, answers, sources = sorted(t for c, t in parsed if c == conv), {}, {}
        for t in turns:
            sources[t] = []
            for number, (level, lines) in enumerate(parsed[conv, t][2]):
                whole, weights = squeeze("\n".join(lines)), Counter()
                for key, weight in [(whole, 1 + sum(bool(squeeze(x)) for x in lines)), *((squeeze(x), 1) for x in lines if squeeze(x))]:
                    earlier = [u for u in turns if u < t and key in parsed[conv, u][1]]
                    if earlier:
                        weights[max(earlier)] += weight
                if weights:
                    place = (conv, max(weights, key=lambda u: (weights[u], u)))
                else:
                    place = min((x for x in parsed if x[0] != conv and whole in parsed[x][1]), default=(None, None))
                sources[t].append((number, level, *place))
            linked = [(-level, u) for _, level, c, u in sources[t] if c == conv]
            before = max((u for u in turns if u < t), default=None)
            answers[t] = max(linked)[1] if linked else before
        branch, children = {}, defaultdict(list)
        for k, t in enumerate(turns):
            before = turns[k - 1] if k else None
            branch[t] = branch.get(before) if answers[t] == before else t
            if answers[t] != before:
                children[answers[t]].append(t)
        order, stack = [], [turns[0]]
        while stack:  # a branch is walked to its end; then what hangs on it, later answered messages first
            walk = [u for u in turns if u >= stack[-1] and branch[u] == branch[stack[-1]]]
            stack.pop()
            order += walk
            stack += [h for u in walk for h in reversed(children[u])]
        for c, t, role, text in rows:
            if c == conv:
                out[c, t, role, text] = (parsed[c, t][0], answers[t], sources[t], branch[t], order.index(t))
    return out


def spans_of_secrets(rows):
    """{doc_id: (all spans joined, live, example)} for (doc_id, text, source) with distinct ids; a document is a repository."""
    kinds, texts = ["assign", "access", "hex", "owned"], {i: t or "" for i, t, _ in rows}
    values, found = defaultdict(lambda: (set(), set())), {}

    def bits(x):
        return sum(-n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())

    def strong(x):
        classes = [re.search(p, x) is not None for p in ("[0-9]", "[a-z]", "[A-Z]")]
        return all(classes) and len(x) >= 12 and bits(x) >= 3.5

    for i, t, source in rows:
        base = [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in secrets(t))]
        spans = []
        for kind, a, b in base:
            value = texts[i][a:b]
            if kind == "assign":  # the value begins behind the first separator after the name
                name = re.match(r"(?i)(password|passwd|secret|token|api_?key)", texts[i][a:b])[0]
                value = re.fullmatch(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", texts[i][a + len(name) : b])[1]
            spans.append((a, kinds.index(kind), b, value, any(c.isdigit() for c in value) and len(value) >= 12 and bits(value) >= 3))
        free = lambda a, b: all(b <= x or y <= a for _, x, y in base)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{18,}[A-Za-z0-9+/_=-]", texts[i]):
            if strong(m[0]) and free(*m.span()):
                spans.append((m.start(), 3, m.end(), m[0], True))
            elif "." in m[0]:
                spans += [(x.start(), 3, x.end(), x[0], True) for x in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", texts[i]) if m.start() <= x.start() and x.end() <= m.end() and strong(x[0]) and free(*x.span())]
        found[i] = sorted(spans)
        for *_, value, _ in spans:
            values[value][0].update({source} - {None})
            values[value][1].add(i)
    out = {}
    for i, spans in found.items():
        told, counts = [], Counter()
        for a, kind, b, value, random in spans:
            owners, repositories = map(len, values[value])
            verdict = "example" if owners >= 3 or (owners > 1 and repositories >= 10) else "live" if random else "weak"
            if kind < 3 or verdict == "live":
                told.append(f"{kinds[kind]}:{a}:{b}")
                counts[verdict] += 1
        out[i] = (",".join(told), counts["live"], counts["example"])
    return out


class Unigram:
    """Language models over pieces (bytes to id), fitted and asked one word at a time."""

    def __init__(self, ids, n_live, rounds=3, smoothing=0.1):
        self.ids, self.widest, self.rounds, self.smoothing, self.n_live = ids, max(map(len, ids)), rounds, smoothing, n_live

    def edges(self, word):
        return [(i, j, word[i:j]) for j in range(1, len(word) + 1) for i in range(max(0, j - self.widest), j) if word[i:j] in self.ids]

    def forward(self, word, chance):
        sums = [1.0] + [0.0] * len(word)
        for i, j, x in self.edges(word):
            sums[j] += sums[i] * chance(x)
        return sums

    def fit(self, words):
        """words: Counter of bytes of one language."""
        chance = lambda x: 1 / self.n_live
        for _ in range(self.rounds):
            counts = defaultdict(float)
            for word, n in words.items():
                edges, sums, back = self.edges(word), self.forward(word, chance), [0.0] * len(word) + [1.0]
                for i, j, x in sorted(edges, reverse=True):
                    back[i] += chance(x) * back[j]
                for i, j, x in edges:
                    counts[x] += n * sums[i] * chance(x) * back[j] / sums[-1]
            total = sum(counts.values()) + self.smoothing * self.n_live
            chance = lambda x, counts=counts, total=total: max((counts.get(x, 0.0) + self.smoothing) / total, 1e-9)
        return chance


def languages(rows, ids, n_live):
    """{doc_id: (lang_pred, score)} for (doc_id, text, lang) with distinct ids and short words."""
    words = {i: Counter(b" " + w.encode() for w in WORD.findall(t or "")) for i, t, _ in rows}
    model, fitted, cache = Unigram(ids, n_live), {}, {}
    for lang in sorted({x for *_, x in rows if x is not None}):
        mine = [words[i] for i, _, x in rows if x == lang and zlib.crc32(str(i).encode()) % 4 != 2]
        if total := sum(mine, Counter()):
            fitted[lang] = model.fit(total)
    out = {}
    for i, t, _ in rows:
        logs = []
        for lang, chance in fitted.items():
            for w in words[i]:
                if (lang, w) not in cache:
                    cache[lang, w] = math.log(model.forward(w, chance)[-1])
            logs.append((sum(n * cache[lang, w] for w, n in words[i].items()), lang))
        top = max(x for x, _ in logs)
        best = max(logs, key=lambda x: x[0])
        known = any(c.isalpha() for c in t or "")
        out[i] = (best[1], 1 / sum(math.exp(x - top) for x, _ in logs)) if known else ("und", 0.0)
    return out


def mixed(x):
    x &= MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def sampled(text, seed, pieces, chance):
    """Ids of one segmentation; seed: 64 bits; chance by id."""
    if not text:
        return []
    data = (" " + text).encode()
    opens = [i for i in range(len(data)) if i == 0 or data[i : i + 1] == b"\n" or data[i - 1 : i] == b"\n" or (data[i : i + 1] == b" " and data[i - 1 : i] != b" ")]
    strings = []
    for a, b in zip(opens, [*opens[1:], len(data)], strict=True):
        at = [a]
        if b - a > 32:
            spans = [(i, j) for i in range(a, b) for j in range(i + 2, min(b, i + pieces.widest) + 1) if data[i:j] in pieces.ids]
            crossed = {k for i, j in spans for k in range(i + 1, j)}
            at = [k for k in range(a, b) if k == a or k not in crossed]
        strings += [data[i:j] for i, j in zip(at, [*at[1:], b], strict=True)]
    out = []
    for token, string in enumerate(strings):
        sums, edges = [1.0] + [0.0] * len(string), defaultdict(list)
        for j in range(1, len(string) + 1):
            for i in range(j - 1, max(-1, j - pieces.widest - 1), -1):
                if string[i:j] in pieces.ids:
                    edges[j].append((i, pieces.ids[string[i:j]]))
                    sums[j] += sums[i] * chance[pieces.ids[string[i:j]]]
        at, ids = len(string), []
        while at:
            u = (mixed(seed ^ mixed(token * 0xD6E8FEB86659FD93 + 1 + (at - 1) * 0xA0761D6478BD642F)) >> 11) * 2.0**-53
            weights = list(itertools.accumulate(sums[i] * chance[x] for i, x in edges[at]))
            at, x = next(e for e, w in zip(edges[at], weights, strict=True) if w / weights[-1] > u)
            ids.append(x)
        out += ids[::-1]
    return out


# Patterns of personal data, in order of precedence.
PRIVATE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![0-9./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d\d-\d{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{4}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?![0-9])",
}


def feistel(values, radixes, key, tweak, rounds=8):
    import xxhash

    values = list(values)
    for turn in range(rounds):
        others = ",".join(str(x) for i, x in enumerate(values) if i % 2 != turn % 2)
        seed = hashlib.sha256(f"{key}|{tweak}|{turn}|{others}".encode()).hexdigest()
        for i in range(turn % 2, len(values), 2):
            stream = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(seed.encode(), seed=42))
            values[i] = (values[i] + (stream - ((stream >> 63) << 64)) % radixes[i]) % radixes[i]
    return values


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10


def pseudonym(kind, x, key):
    """What a match becomes; itself if its check fails."""
    digits, parts = [int(c) for c in x if c.isdigit()], [int(p) for p in re.findall("[0-9]+", x)]
    fill = lambda new: "".join(str(next(new)) if c.isdigit() else c for c in x)
    if kind == "email":
        name, _, host = x.partition("@")
        chars = [c for c in name if c.isalnum()]
        least = [ord("0") if c.isdigit() else ord("A") if c.isupper() else ord("a") for c in chars]
        new = iter(feistel([ord(c) - a for c, a in zip(chars, least, strict=True)], [10 if a == 48 else 26 for a in least], key, f"email-{host}"))
        shift = iter(least)
        return "".join(chr(next(new) + next(shift)) if c.isalnum() else c for c in name) + "@" + host
    if kind == "card" and luhn(digits) == 0:
        body = [digits[0], *feistel(digits[1:-1], [10] * (len(digits) - 2), key, f"card-{len(digits)}-{digits[0]}")]
        return fill(iter([*body, -luhn([*body, 0]) % 10]))
    if kind == "phone":
        american = x[0] != "+" or x.startswith("+1")
        if len(digits) in ((10, 11) if american else range(8, 16)):
            lead = len(digits) - 10 if american else 2
            body = digits[lead:]
            least = [2 if american and i in (0, 3) and d > 1 else 0 for i, d in enumerate(body)]
            radix = [(8 if d > 1 else 2) if american and i in (0, 3) else 10 for i, d in enumerate(body)]
            new = feistel([d - a for d, a in zip(body, least, strict=True)], radix, key, "phone-1" if american else f"phone-{digits[0]}{digits[1]}")
            return fill(iter([*digits[:lead], *(d + a for d, a in zip(new, least, strict=True))]))
    if kind == "ip" and max(parts) < 256:
        return ".".join(map(str, feistel(parts, [256] * 4, key, "ip")))
    if kind == "ssn" and 0 < parts[0] < 900 and parts[0] != 666 and parts[1] and parts[2]:
        a, g, n = feistel([parts[0] - 1 - (parts[0] > 666), parts[1] - 1, parts[2] - 1], [898, 99, 9999], key, "ssn")
        return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{n + 1:04}"
    if kind == "date":
        layouts = ["%d.%m.%Y"] if "." in x else ["%m/%d/%Y", "%d/%m/%Y"] if re.search("/[0-9]{4}$", x) else ["%Y/%m/%d" if "/" in x else "%Y-%m-%d"]
        for layout in layouts:
            try:
                day = datetime.datetime.strptime(x, layout).date()
            except ValueError:
                continue
            if not 1000 <= day.year <= 9799 or (layout == "%d/%m/%Y" and parts[0] <= 12):
                continue
            n = (day - datetime.date(1000, 1, 1)).days
            a, b = feistel([n % 146_097 // 773, n % 146_097 % 773], [189, 773], key, f"date-{n - n % 146_097}")
            new = datetime.date(1000, 1, 1) + datetime.timedelta(n - n % 146_097 + a * 773 + b)
            return layout.replace("%d", f"{new.day:02}").replace("%m", f"{new.month:02}").replace("%Y", f"{new.year:04}")
    return x


def pseudonyms(text, key):
    """(text, {kind: number of changed values})."""
    counts = Counter()

    def change(m):
        kind = next(k for k, p in PRIVATE.items() if re.fullmatch(f"(?a:{p})", m[0]))
        new = pseudonym(kind, m[0], key)
        counts[kind] += new != m[0]
        return new

    return re.sub("|".join(f"(?a:{p})" for p in PRIVATE.values()), change, text), counts
