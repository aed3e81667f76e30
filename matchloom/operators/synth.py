"""Labelled noisy copies of anchors: the fixture on which everything is tried end to end."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# How many copies an anchor has (0..8), and how decoys are made.
COPIES = (0.056, 0.054, 0.170, 0.240, 0.219, 0.146, 0.074, 0.029, 0.012)
DECOYS = {"namesake_elsewhere": 5.0, "other_number": 13.5, "word_swapped": 27.0, "word_dropped": 22.0, "same_street": 32.5}
DECOY_SHARE, HELD_OUT, CAPS = 0.374, 0.15, {"S2": 5, "S3": 6}


def _typo(rnd: random.Random, s: str) -> str:
    if len(s) < 4:
        return s
    i = rnd.randrange(1, len(s) - 2)
    return rnd.choice([s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:]])


def noisy(rnd: random.Random, name: str, address: str, source: str) -> tuple[str, str]:
    if rnd.random() < 0.25:
        name = _typo(rnd, name)
    if rnd.random() < 0.1 and " " in name:
        name = "".join(w[0] for w in name.split()).upper() if len(name.split()) > 2 else name
    name = name.upper() if source == "S2" and rnd.random() < 0.5 else name
    if source == "S3" and rnd.random() < 0.05:
        name = name.replace(" ", "").lower() + ".com"
    if rnd.random() < 0.1:
        address = ""
    elif rnd.random() < 0.2:
        address = _typo(rnd, address)
    return name, address


def decoy(rnd: random.Random, kind: str, name: str, address: str) -> tuple[str, str]:
    words = name.split()
    number, _, street = address.partition(" ")
    if kind == "namesake_elsewhere":
        return name, f"{rnd.randrange(1, 999)} other street"
    if kind == "other_number":
        return name, f"{rnd.randrange(1000, 9999)} {street}"
    if kind == "word_swapped":
        words[rnd.randrange(len(words))] = rnd.choice(["group", "north", "prime", "global"])
        return " ".join(words), address
    if kind == "word_dropped" and len(words) > 1:
        words.pop(rnd.randrange(len(words)))
        return " ".join(words), address
    return f"{rnd.choice(['alpha', 'delta', 'omega'])} {rnd.choice(['works', 'traders'])}", address


def copies(anchors: DataFrame, seed: int = 17) -> DataFrame:
    """entity_id, business_name, business_address, country, owner (null for decoys and copies of held-out anchors)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for eid, name, address, country in f[["entity_id", "business_name", "business_address", "country"]].itertuples(index=False):
                rnd = random.Random(f"{seed}:{eid}")
                held, used = rnd.random() < HELD_OUT, {"S2": 0, "S3": 0}
                n = rnd.choices(range(9), COPIES)[0]
                extra = sum(rnd.random() < DECOY_SHARE / (1 - DECOY_SHARE) for _ in range(n))
                for k in range(n + extra):
                    source = rnd.choice(["S2", "S3"])
                    if k < n and used[source] >= CAPS[source]:
                        continue
                    used[source] += k < n
                    pair = noisy(rnd, name, address, source) if k < n else decoy(rnd, rnd.choices(list(DECOYS), list(DECOYS.values()))[0], name, address)
                    rows.append((f"{source}-{eid}-{k}", *pair, country, eid if k < n and not held else None))
            yield pd.DataFrame(rows, columns=["entity_id", "business_name", "business_address", "country", "owner"])

    return anchors.mapInPandas(run, "entity_id string, business_name string, business_address string, country string, owner string")
