"""Command line: preview, health, analyze, search, report, repair, organize, lookup, covers over a catalogue."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from bookwarp.log import log_to
from bookwarp.operators import assemble as A
from bookwarp.operators import covers, duplicates, score, search, statistics
from bookwarp.operators.inspect import dashboard
from bookwarp.plans import changes, files, organize
from bookwarp.providers import mapping
from bookwarp.providers.lookup import SERVICES, USER_AGENT, Lookup, ProviderUnavailable
from bookwarp.reports import presets, sinks, tables
from bookwarp.session import local_session
from bookwarp.sources.cache import ResponseCache
from bookwarp.sources.sqlite import read_catalogue, write_values
from bookwarp.stage import cut


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bookwarp", description="Quality analytics of a book catalogue")
    top.add_argument("--database", required=True, help="SQLite file of the catalogue")
    top.add_argument("--log", metavar="FOLDER", help="note commands and their outcome in a log here")
    sub = top.add_subparsers(dest="command")
    add = lambda name, **kw: sub.add_parser(name, **kw)
    add("preview", help="a few books and their counts").add_argument("--limit", type=int, default=20)
    add("health", help="average score and the worst books").add_argument("--limit", type=int, default=10)
    add("analyze", help="numbers of all findings").add_argument("--output")
    p = add("search", help="books that fulfil all terms")
    p.add_argument("terms", nargs="+")
    p.add_argument("--sort", choices=search.SORTS)
    p.add_argument("--descending", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--output")
    p = add("report", help="write a report")
    p.add_argument("kind", choices=[*tables.REPORTS, "duplicates"])
    p.add_argument("--format", choices=list(sinks.SINKS), default="csv")
    p.add_argument("--output", required=True)
    p = add("repair", help="suggested titles and author merges; a preview unless --apply")
    p.add_argument("--apply", metavar="FOLDER", help="write the changed tables here, after a backup of the database")
    p = add("organize", help="folders and files that should move; a preview unless --apply")
    p.add_argument("--library", required=True)
    p.add_argument("--apply", action="store_true")
    p = add("lookup", help="a book beside what a service says")
    p.add_argument("book_id", type=int)
    p.add_argument("--service", choices=list(SERVICES), default="openlibrary")
    p.add_argument("--cache", default=".cache")
    p.add_argument("--offline", action="store_true")
    p = add("covers", help="covers for a book, from services and a folder; a preview unless --apply")
    p.add_argument("--book", type=int, help="only this book; needed for --service and --apply")
    p.add_argument("--folder", help="images named by book id")
    p.add_argument("--service", choices=list(SERVICES))
    p.add_argument("--cache", default=".cache")
    p.add_argument("--offline", action="store_true")
    p.add_argument("--library", help="folder of the books' own covers")
    p.add_argument("--apply", action="store_true", help="save the chosen cover, after a backup of the database")
    choice = p.add_mutually_exclusive_group()
    choice.add_argument("--best", action="store_true")
    choice.add_argument("--candidate", type=int)
    return top


def fetch_bytes(url: str) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=10) as answer:
        return answer.read()


def _covers(args, spark, books, say) -> int:
    """Lists candidates; with ``--apply`` saves one of a book's and notes it in the database."""
    book = None
    if args.book is not None:
        book = books.filter(books.id == args.book).select("id", "isbn", "title", "path", A.author_names().alias("author")).first()
        if book is None:
            say(f"Book {args.book} not found")
            return 1
    if book is None and (args.service or args.apply):
        say("--service and --apply need --book")
        return 2
    downloaded = folder = None
    if args.service:
        asked = Lookup(args.service, ResponseCache(Path(args.cache) / args.service), offline=args.offline)
        try:
            downloaded = covers.downloaded_covers(spark, asked.candidates(spark, book.id, book.isbn, book.title, book.author), fetch_bytes)
        except ProviderUnavailable as error:
            say(error)
    if args.folder:
        folder = covers.user_folder_covers(spark, args.folder)
        folder = folder if book is None else folder.filter(folder.book_id == book.id)
    if downloaded is None and folder is None:
        say("No covers to look at: name a --folder or a --service")
        return 2
    if args.library and list(Path(args.library).rglob("cover.jpg")):
        existing = covers.present_covers(spark, books if book is None else books.filter(books.id == book.id), args.library)
    else:
        existing = spark.createDataFrame([], "book_id bigint, content binary")
    found = cut(covers.numbered(covers.flag_duplicates(covers.gathered(folder, downloaded), existing)))
    for row in covers.candidate_lines(found).orderBy("book_id", "number").collect():
        say(row.book_id, f"[{row.number}]", row.line)
    if not args.apply:
        return 0
    if args.best:
        best = covers.best_covers(found.filter(found.book_id == book.id), "number").first()
        number = best.number if best else None
    else:
        number = args.candidate
    chosen = found.filter((found.book_id == book.id) & (found.number == number)).first() if number is not None else None
    if chosen is None or not chosen.is_valid:
        say("No candidate to save" if chosen is None else "The candidate is not valid: " + "; ".join(chosen.issues))
        return 1
    say("backup", changes.backup_file(args.database))
    error = files.save_cover(Path(args.library or Path(args.database).parent) / book.path, bytes(chosen.content))
    if error:
        say(error)
        return 1
    write_values(args.database, "books", "has_cover", ["id"], [(1, book.id)])
    say(f"Cover saved for {book.id}")
    return 0


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if not args.log:
        return run(args, spark, out)
    logger = log_to(args.log)
    logger.info("%s on %s", args.command or "preview", args.database)
    try:
        code = run(args, spark, out)
    except Exception:
        logger.exception("failed")
        raise
    logger.info("ended with %d", code)
    return code


def run(args: argparse.Namespace, spark=None, out=sys.stdout) -> int:
    spark = spark or local_session()
    say = lambda *x: print(*x, file=out)
    catalogue = read_catalogue(spark, args.database)
    books = A.assemble(catalogue)
    command = args.command or "preview"
    if command == "preview":
        sample = books.orderBy("id").limit(getattr(args, "limit", 20))  # the counts are those of the books shown
        for line in presets.lines(A.table_rows(sample)) + presets.lines(statistics.summary(sample)):
            say(line)
    elif command == "health":
        say(f"Average score: {score.average_score(books).first()[0]}")
        for row in score.worst(books, args.limit).collect():
            say(row.score, row.book_id, row.title)
    elif command == "analyze":
        for row in dashboard(books).collect():
            say(f"{row.label}: {row.value}")
        if args.output:
            say(sinks.write_report(tables.library_analysis(books), args.output))
    elif command == "search":
        found = search.search(books, args.terms, args.sort, args.descending)
        for row in tables.search_results(found).limit(args.limit).collect():
            say(row.book_id, row.title, "-", row.author)
        if args.output:
            say(sinks.write_report(tables.search_results(found), args.output))
    elif command == "report":
        table = duplicates.duplicate_report(books, catalogue["authors"]) if args.kind == "duplicates" else tables.REPORTS[args.kind](books)
        say(sinks.write_report(table, args.output, args.format))
    elif command == "repair":
        suggested, groups = score.repair_suggestions(books), duplicates.author_groups(catalogue["authors"])
        for line in presets.lines(changes.repair_results(suggested)) + presets.lines(groups):
            say(line)
        if args.apply:
            say("backup", changes.backup_file(args.database))
            sinks.write_bulk(changes.apply_repairs(catalogue["books"], suggested), f"{args.apply}/books.parquet")
            sinks.write_bulk(changes.merged_links(catalogue["books_authors_link"], groups), f"{args.apply}/books_authors_link.parquet")
            sinks.write_bulk(changes.merged_authors(catalogue["authors"], groups), f"{args.apply}/authors.parquet")
    elif command == "organize":
        plan = organize.organize_plan(books)
        for line in presets.lines(organize.plan_report(plan.filter("has_changes")).orderBy("book_id")):
            say(line)
        if args.apply:
            say("backup", changes.backup_file(args.database))
            done = files.carry_out(plan, args.library, apply=True)
            say(f"{sum(r.moved for r in done)} moved, {sum(bool(r.error) for r in done)} failed")
            for line in presets.failures(done):
                say(line)
            write_values(args.database, "books", "path", ["id"], [(r.proposed_path, r.book_id) for r in done if r.moved and not r.error])
            write_values(args.database, "data", "name", ["book", "format"], [(new, r.book_id, f) for r in done for f, new in r.names])
    elif command == "lookup":
        book = books.filter(books.id == args.book_id)
        row = book.select("id", "isbn", "title", A.author_names().alias("author")).first()
        if row is None:
            say(f"Book {args.book_id} not found")
            return 1
        asked = Lookup(args.service, ResponseCache(Path(args.cache) / args.service), offline=args.offline)
        for line in presets.lines(mapping.comparison(mapping.local_candidates(book), asked.candidates(spark, row.id, row.isbn, row.title, row.author))):
            say(line)
    elif command == "covers":
        return _covers(args, spark, books, say)
    return 0


if __name__ == "__main__":
    sys.exit(main())
