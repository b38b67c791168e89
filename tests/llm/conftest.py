from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

# Names that an operator might use for columns of its own.
CLASHES = ("n", "kept", "size", "component", "component_id", "path", "host", "row", "group", "score", "_id", "words", "start")


def _write(folder, name, columns, rows):
    """One table, with extra columns whose names clash."""
    cols = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns)}
    cols |= {c: pa.array(["x"] * len(rows), pa.string()) for c in CLASHES}
    pq.write_table(pa.table(cols), folder / f"{name}.parquet")


DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
PAGES = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]
VECTORS = [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int64())]
LABELS = [("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())]


def odd_vectors() -> list[tuple]:
    """Null and damaged vectors, equal ones, zeros, null labels; ids in no order."""
    rng = random.Random(6)
    rows = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(60)]
    rows += [rows[0], rows[0], [0.0] * 16, [1.0 / 64] * 16, [-1.0 / 64] * 16, rows[3], None, [None] + rows[1][1:], [float("nan")] + rows[1][1:],
             rows[1][1:] + [float("inf")], [1000.0] * 16]
    rows += [[x + rng.choice([0, 0.001]) for x in rows[5]] for _ in range(30)]
    ids = list(range(-10, len(rows) - 10))
    rng.shuffle(ids)
    return [(i, r, None if i % 4 == 0 else i % 3) for i, r in zip(ids, rows)]


def odd_documents() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [None, "", "   \n\t ", "one", "two words", "Two Words", " ", "été 中文 \U0001f600 <|endoftext|> a", "#*$ %&|<>\n\n#*$ %&|<>",
             "same line here\nsame line here\nsame line here", " ".join(["again"] * 300)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 700]))]
        texts += [" ".join(base)] * 3
        for k in (1, 2, len(base) // 12):
            near = list(base)
            for _ in range(k):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    langs, sources = ["en", "de", None], ["web", "books", None, "\U0001f600", "code"]
    return [(i, t, langs[i % 3], sources[0] if i % 3 == 0 else sources[i % 5], None if i % 7 == 0 else i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = odd_documents()
    _write(folder, "documents", DOCS, docs)
    _write(folder, "labels", LABELS, [(d[0], None if d[0] % 9 == 0 else int(d[0] % 3 > 0), 0) for d in docs] + [(None, 1, None), (10 ** 6, 0, 0)])
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>%s</p></article><footer>Imprint</footer></body></html>"
    html = [None, "", "no markup at all", page % "It rained for most of the day &amp; nobody in the town minded it much.", "<p>open <b>tags",
            page % ("long " * 40_000), page % "WARC/1.1\r\nWARC-Type: response\r\n\r\n", page % "It rained for most of the day &amp; nobody in the town minded it much."]
    urls = [None, "no scheme", "http://EXAMPLE.org/es/x?y", "https://a.example.org/en/12#f", "http://x.com/fr/", "http://x.com/de/a/b", "http://poker.net", "://\n/"]
    _write(folder, "pages", PAGES, [(i, urls[i], html[i]) for i in range(8)])
    _write(folder, "embeddings", VECTORS, odd_vectors())
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, columns in (("documents", DOCS), ("pages", PAGES), ("labels", LABELS), ("embeddings", VECTORS)):
        _write(folder, name, columns, [])
    return str(folder)
