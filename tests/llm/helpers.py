"""Plain versions that the operators are held against."""

import re
from itertools import combinations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def components(ids, links):
    """Smallest id reachable from each id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_links(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    return [
        (a, b)
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def without_repeated_windows(texts, width=3):
    """Texts by id in order, later occurrences of windows of lines taken out."""
    ends, seen, out = " \t\r\x0b\x0c", set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        full = [(k, line.strip(ends)) for k, line in enumerate(lines) if line.strip(ends)]
        gone = set()
        for k in range(len(full) - width + 1):
            window = tuple(line for _, line in full[k : k + width])
            if window in seen:
                gone.update(at for at, _ in full[k : k + width])
            seen.add(window)
        left = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out[i] = texts[i] if not gone else left if left.strip(ends + "\n") else ""
    return out
