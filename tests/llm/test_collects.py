"""Driver-side collection in the corpus operators: only where the result is bounded."""

import pathlib
import re

ALLOWED = {
    "decontaminate.py": 2,  # one row a power of two of item sizes; four widths
    "fingerprints.py": 1,   # one row a range, four times the shuffle partitions
    "graph.py": 1,          # one row
    "packing.py": 2,        # one number each
    "prefix_trie.py": 2,    # one number each
    "quality.py": 2,        # the training sample, TRAIN_ROWS and TRAIN_BYTES at most
    "substring.py": 1,      # one number
    "toxicity.py": 6,       # sums in one row, four counts, BROADCAST_ENTRIES entries, features of HEAD_ROWS rows
}


def test_corpus_operators_collect_only_bounded_results():
    root = pathlib.Path(__file__).resolve().parents[2] / "salesengine" / "llm"
    for path in sorted(root.glob("*.py")):
        n = len(re.findall(r"(?<!F)\.(collect|first|toPandas|toArrow|take|head)\(", path.read_text()))
        assert n <= ALLOWED.get(path.name, 0), (path.name, n)
