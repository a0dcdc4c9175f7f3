"""python -m lexmill PATH COMMAND ...

find TEXT | get KEY [FILE] | id ID | iterate COLLECTION [NS] | top N | upload COLLECTION FOLDER
crawl URL [DEPTH]                      within the URL's host, ports 80 and 8080, no address with /blog
overlap FOLDER                         4-gram overlap of each <id>.html with the next one
pairs FILE FOLDER                      store the pairs of a file, and their documents <id>.html
train | check [N]                      fit a classifier on the stored pairs; judge it on N random picks (125)
charset SAMPLES FILE...                detect by profiles of the files in a folder, each named as its charset
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from lexmill.engine import SearchEngine
from lexmill.functions.charset import detect, train_profiles
from lexmill.functions.html import plain_text
from lexmill.operators import crawl, model, similarity
from lexmill.operators.search import as_json
from lexmill.session import cut, local_session
from lexmill.sources.readers import directory, html_documents, pair_file, text_files
from lexmill.sources.web import http_fetcher


def find(engine: SearchEngine, *words: str) -> int:
    n = 0
    for n, row in enumerate(as_json(engine.find(" ".join(words))).toLocalIterator(), 1):
        print(row["json"])
    print(f"Found {n} documents")
    return 0 if n else 1


def _show(row: dict, file: str | None) -> None:
    if file is None:
        print(row["data"])
    else:
        Path(file).write_text(row["data"])


def get(engine: SearchEngine, key: str, file: str | None = None) -> None:
    _show(engine.store.read(key), file)


def by_id(engine: SearchEngine, doc_id: str) -> None:
    _show(engine.store.read_by_id(doc_id), None)


def iterate(engine: SearchEngine, *asked: str) -> None:
    for row in engine.iterate(*asked).select("key", F.octet_length("data").alias("size")).toLocalIterator():
        print(row["key"], row["size"])


def top(engine: SearchEngine, n: str) -> None:
    for row in engine.top_words(int(n)).orderBy("key", "rank").toLocalIterator():
        print(row["key"], row["token"], round(row["score"], 6))


def upload(engine: SearchEngine, collection: str, folder: str) -> None:
    engine.upload(text_files(engine.spark, folder).select(F.col("name").alias("key"), F.col("text").alias("data")), collection)


def crawl_site(engine: SearchEngine, url: str, depth: str = "3", fetch=None) -> None:
    from urllib.parse import urlsplit

    engine.add_url_filter(crawl.domain_filter(urlsplit(url).hostname or ""))
    engine.add_url_filter(crawl.port_filter([80, 8080]))
    engine.add_url_filter(crawl.words_filter(["/blog"]))
    engine.add_processor(engine.index_pages)
    for row in engine.crawl([url], fetch or http_fetcher(), cut, int(depth)).orderBy("level", "url").toLocalIterator():
        print(row["level"], row["url"])
    print(f"Processed {engine.total} pages")


def _pages(engine: SearchEngine, folder: str):
    return html_documents(engine.spark, folder).select("doc_id", plain_text(F.col("html")).alias("text"))


def overlap(engine: SearchEngine, folder: str) -> None:
    for row in similarity.consecutive_overlap(_pages(engine, folder), "doc_id", "text").orderBy("first").toLocalIterator():
        print(row["first"], row["second"], row["percent"], "match" if row["matched"] else "")


def pairs(engine: SearchEngine, file: str, folder: str) -> None:
    store, read = similarity.PairStore(engine.spark, f"{engine.store.path}/pairs"), pair_file(engine.spark, file)
    wanted = similarity.pair_documents(read)
    store.write_documents(_pages(engine, folder).join(wanted, "doc_id", "left_semi"), "doc_id", "text")
    store.write_elements(read)
    print(f"Stored {store.elements().count()} pairs and {store.documents().count()} documents")


def train(engine: SearchEngine) -> None:
    features = cut(similarity.PairStore(engine.spark, f"{engine.store.path}/pairs").features())
    trained = model.train(features.where(model.in_training(F.col("line_no"))))
    model.save(trained, f"{engine.store.path}/model")
    model.evaluate(trained, features.where(~model.in_training(F.col("line_no")))).show()


def check(engine: SearchEngine, n: str = "125") -> None:
    features = similarity.PairStore(engine.spark, f"{engine.store.path}/pairs").features()
    model.evaluate(model.load(f"{engine.store.path}/model"), model.random_picks(features, int(n))).show()


def charset(engine: SearchEngine, samples: str, *files: str) -> None:
    profiles = train_profiles({r["name"]: bytes(r["content"]) for r in directory(engine.spark, samples).toLocalIterator()})
    for file in files:
        print(file, detect(Path(file).read_bytes(), profiles))


COMMANDS = {
    "find": find, "get": get, "id": by_id, "iterate": iterate, "top": top, "upload": upload, "crawl": crawl_site,
    "overlap": overlap, "pairs": pairs, "train": train, "check": check, "charset": charset,
}


def main(args: list[str], engine: SearchEngine | None = None) -> int:
    if len(args) < 2 or args[1] not in COMMANDS:
        print(__doc__)
        return 2
    try:
        return COMMANDS[args[1]](engine or SearchEngine(local_session(), args[0]), *args[2:]) or 0
    except KeyError:
        print("no such document", file=sys.stderr)
        return 1
    except TypeError as e:
        if args[1] not in str(e) and "positional argument" not in str(e):
            raise
        print(__doc__)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
