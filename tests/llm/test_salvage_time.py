"""Salvage of compressed archives takes time in proportion to their members."""

import gzip
import random
import time

from mojiframe.llm import warc


def test_twice_the_members_take_about_twice_the_time():
    rng = random.Random(1)
    members = [gzip.compress(warc.encode_record(str(i), None, rng.randbytes(3000)) + b"\r\n\r\n", 1) for i in range(4000)]
    seconds = []
    for n in (1000, 4000):
        data = b"".join(members[:n])
        start = time.process_time()
        got = list(warc.salvage(data))
        seconds.append(time.process_time() - start)
        assert len(got) == n and all(r[2] for r in got) and got[-1][1] == len(data)
    assert seconds[1] < 8 * seconds[0] + 0.2  # sixteen times if every member read the rest
