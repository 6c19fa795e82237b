"""The piece lattice on text without a space: memory grows with the length, not with its square."""

import random
import subprocess
import sys

from reelscope.llm import pieces, queries

RUN = """
import base64, random, resource
from reelscope.llm import pieces, queries
path = queries.tokenizer_file("piece_bpe_32k.model")
text = base64.b64encode(random.Random(1).randbytes(150_000)).decode()
work = pieces.encoder(path, 4, ("n_tokens", "score", "nbest_scores", "nbest_ids_crc32", "ids_crc32", "round_trip"))()
now = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (now + 700 * 2**20,) * 2)
got = {k: v.to_pylist()[0] for k, v in work([text]).items()}
assert got["round_trip"] and got["nbest_scores"][0] == got["score"] and len(got["nbest_scores"]) == 4
assert len(set(got["nbest_ids_crc32"])) == 4 and got["nbest_ids_crc32"][0] == got["ids_crc32"]
"""


def test_a_long_run_fits_in_memory():
    done = subprocess.run([sys.executable, "-c", RUN], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_order_of_paths():
    rng, tree, lists = random.Random(2), pieces.Paths(), [()]
    for _ in range(3000):
        at = rng.choice([len(lists) - 1, rng.randrange(len(lists))])
        step = rng.randrange(1, 1000)
        lists.append((*lists[at], step))
        assert tree.add(at, step) == len(lists) - 1
    for _ in range(5000):
        a, b = rng.sample(range(len(lists)), 2)
        if lists[a] != lists[b]:
            assert tree.before(a, b) == (lists[a] < lists[b])
        assert tuple(tree.steps(a)) == lists[a][::-1]


def test_long_segments_match_kept_arcs(monkeypatch):
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = [["".join(rng.choice("acgtthe") for _ in range(rng.randrange(1, 150))) for _ in range(3)] for _ in range(40)]
    found = [model.n_best(t, 5) for t in texts]
    monkeypatch.setattr(pieces, "LONG", 10**9)
    assert found == [model.n_best(t, 5) for t in texts]
