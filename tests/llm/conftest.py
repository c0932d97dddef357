import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mojiframe.llm.common import ship

SYLLABLES = ["ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sha", "tion", "ing", "é"]


@pytest.fixture(autouse=True)
def _package_on_workers(spark):
    ship(spark)


def words(rng: random.Random, n: int, low: int = 1, high: int = 3) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(low, high))) for _ in range(n))


def lines(rng: random.Random, n: int) -> str:
    return "\n".join(words(rng, rng.randint(3, 14)).capitalize() + "." for _ in range(n))


def _documents() -> list[tuple]:
    rng = random.Random(5)
    passage = ". ".join(words(rng, 15).capitalize() for _ in range(4)) + "."  # 60 words in one paragraph
    rows = []
    for i in range(60):
        text = lines(rng, rng.randint(2, 12))
        if i % 7 == 0:
            text = f"{text}\n{passage}\n{lines(rng, 3)}"
        rows.append((i, text, ["en", "de", None][i % 3]))
    base = rows[1][1]
    rows += [(100 + i, base, "en") for i in range(6)]                                     # exact copies
    rows += [(200 + i, base + f" {words(rng, 1)} {i}", "en") for i in range(8)]           # near copies
    chain = words(rng, 80).split()
    for i in range(8):                                                                     # a chain: neighbours link, ends do not
        chain[i * 9] = f"edit{i}"
        rows.append((300 + i, " ".join(chain), "de"))
    rows += [(400, "", "en"), (401, None, "en"), (402, " \t\n ", "en"), (403, "12 ... !!", "de"), (404, "one", None), (405, "two words", "en"),
             (406, "TWO Words", "de"), (407, "two  words\n", "de"), (None, "null id with some words here", "en"), (None, base, "en"), (None, None, None),
             (408, base, "en"), (408, base, "en"), (409, "a b c d e f g h i j k l", "en"), (409, "other text under an id twice", "de"),
             (410, words(rng, 30_000), "en"), (411, "x" * 50_000, "de"), (412, "word " * 5_000, "en"), (413, "don't  stop　\n\n 's 12½ 😀é\x1f", "en")]
    rng.shuffle(rows)
    return rows


def _table(columns: dict, clash: bool) -> pa.Table:
    """With ``clash``, further columns under names that operators use themselves."""
    t = pa.table(columns)
    if clash:
        for name in ("id", "node", "n", "score", "keep0", "label", "key", "h", "s", "train", "spans", "payload", "v", "host", "day"):
            if name not in t.column_names:
                t = t.append_column(name, pa.array([f"clash{i}" for i in range(t.num_rows)], pa.string()))
    return t


def _write(folder, empty: bool) -> str:
    cut = (lambda rows: rows[:0]) if empty else (lambda rows: rows)
    docs = cut(_documents())
    col = lambda rows, k, kind: pa.array([r[k] for r in rows], kind)
    long, string = pa.int64(), pa.string()
    out = {"documents": _table({"doc_id": col(docs, 0, long), "text": col(docs, 1, string), "lang": col(docs, 2, string),
                                "source": pa.array(["s0"] * len(docs), string),
                                "n_chars": pa.array([len(r[1] or "") for r in docs], pa.int32())}, not empty)}
    texts = [r[1] for r in _documents() if r[1] and r[0] is not None and r[0] < 60]
    texts = sorted(texts)
    bench = cut([(0, " ".join(texts[3].split()[4:30])), (1, "TWO words"), (2, None), (3, " .. "), (None, "null item words"), (4, texts[5].upper()),
                 (4, texts[6]), (5, "one"), (6, "not to be found in any of the documents at all today")])
    out["benchmark"] = _table({"item_id": col(bench, 0, long), "text": col(bench, 1, string)}, not empty)
    labels = cut([(r[0], [0, 1, 1, None][(r[0] or 0) % 4], 0) for r in _documents()])
    out["labels"] = _table({"doc_id": col(labels, 0, long), "quality": col(labels, 1, pa.int32()), "toxic": col(labels, 2, pa.int32())}, not empty)
    pages = cut([(1, "http://a.example.org/x/y?q#f", "<p>é</p>"), (2, "https://u:p@A.Example.org:80/x/", "<p>é</p>"), (3, None, None), (4, "no url", ""),
                 (5, "http://b.org", "x" * 100_000), (6, "http://b.org./", "<p>é</p>"), (None, "http://b.org/n", "z"), (7, "http://c.d.e.example.org/x/y/z/w", "z"),
                 (1, "http://a.example.org/x/y?q#f", "<p>é</p>"), (8, "http://a.example.org/" + "s/" * 3_000, "WARC/1.1\r\n\r\n")]
                + [(i, f"http://h{i % 5}.example.org/x/{i % 7}", f"<p>{i % 11}</p>") for i in range(20, 90)])
    out["pages"] = _table({"page_id": col(pages, 0, long), "url": col(pages, 1, string), "html": col(pages, 2, string)}, not empty)
    rng = random.Random(9)
    vec = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    vec += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [None] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7),
            (206, [1.0, 2.0]), (None, [1.0] * 8), (220, vec[0][1]), (240, vec[0][1]), (220, vec[0][1]), (260, [3.0, 4.0])]
    vec = cut(vec)
    out["embeddings"] = _table({"vec_id": col(vec, 0, long), "embedding": col(vec, 1, pa.list_(pa.float64())), "label": col([(0,)] * len(vec), 0, pa.int32())}, not empty)
    for name, t in out.items():
        pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory) -> str:
    """Tables with nulls, empty and long texts, copies, ties, repeated rows and clashing extra columns."""
    return _write(tmp_path_factory.mktemp("edge"), False)


@pytest.fixture(scope="session")
def hollow(tmp_path_factory) -> str:
    """The same tables without rows."""
    return _write(tmp_path_factory.mktemp("hollow"), True)


@pytest.fixture(scope="session")
def read():
    def rows(folder: str, table: str, *columns: str) -> list[tuple]:
        t = pq.read_table(f"{folder}/{table}.parquet", columns=list(columns))
        return list(zip(*[t.column(c).to_pylist() for c in columns]))

    return rows
