import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(ascii_lower(text))


def as_counter(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def components(nodes, links):
    """Nodes by number to their component's smallest number."""
    up = list(range(nodes))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        r, s = root(a), root(b)
        up[max(r, s)] = min(r, s)
    return [root(i) for i in range(nodes)]


def smallest(ids, roots):
    """The smallest id, nulls passed over, of every row's component."""
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]
