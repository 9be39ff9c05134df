"""Notices that are not alone in their line, paragraph or text."""

import itertools
from collections import Counter

from quillmere.llm import licences


def brute(text, template, threshold=0.8):
    """Best Dice of all runs of a text's words."""
    grams, own = licences.bigrams_of(text), Counter(licences.bigrams_of(template))
    spans = itertools.combinations(range(len(grams) + 1), 2)
    return max((round(2 * (Counter(grams[a:z]) & own).total() / (z - a + own.total()), 6) for a, z in spans), default=0)


def test_notices_inside_longer_text(spark):
    known = licences.TEMPLATES
    header = known["Apache-2.0-header"].split()
    wrapped = "\n".join(" * " + " ".join(header[n : n + 7]) for n in range(0, len(header), 7))
    texts = [
        "It is small. Released under the MIT License. It has no parts.",
        f"/*\n{wrapped}\n */\nimport os\n" + "\n".join(f"x{n} = {n}" for n in range(200)),
        "Copyright. " + known["MIT-text"] + " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, " + "express or implied and so on " * 15,
        "a. All rights reserved. b. All rights reserved. c",
        "all rights were reserved under the old law",
        "This work is now licensed under the GNU Lesser General Public License, version 3, and more is said here",
        "Under the MIT rules it was released, under the MIT sun",
    ]
    got = {(r.doc_id, r.licence): (r.dice, r.n_units) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0, "MIT"] == (1.0, 1) and got[1, "Apache-2.0-header"] == (1.0, 1) and got[2, "MIT-text"] == (1.0, 1) and got[3, "Proprietary"] == (1.0, 2)
    for (n, text), (name, template) in itertools.product(enumerate(texts), known.items()):
        if len(licences.bigrams_of(text)) < 150:
            best = brute(text, template)
            assert got.get((n, name), (0,))[0] == (best if best >= 0.8 else 0), (n, name)
