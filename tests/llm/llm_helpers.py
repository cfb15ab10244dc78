"""Brute-force versions that several tests use."""

import collections

import numpy as np

from loomlog.llm import repeats


def removed_bytes(texts, keep_first=False):
    """Bytes of each text that lie in a repeated string, by looking at all of them."""
    places = collections.defaultdict(list)
    data = [t.encode() for t in texts]
    for k, b in enumerate(data):
        for p in range(len(b) - repeats.LENGTH + 1):
            places[b[p : p + repeats.LENGTH]].append((k, p))
    gone = [np.zeros(len(b), bool) for b in data]
    for found in places.values():
        if len(found) > 1:
            for k, p in found[keep_first:]:
                gone[k][p : p + repeats.LENGTH] = True
    return data, gone
