"""Command line: ``python -m palimpsest.cli [--repo PATH] COMMAND ...``."""

from __future__ import annotations

import argparse
import getpass
import sys
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import chunking, diff, graph, scans, stats
from palimpsest.session import session
from palimpsest.sources import imports, remotes
from palimpsest.sources.repository import Repository

Command = Callable[[SparkSession, argparse.Namespace], None]


def _author(args: argparse.Namespace) -> str:
    return args.author or getpass.getuser()


def _open(spark: SparkSession, args: argparse.Namespace) -> Repository:
    return Repository.open(spark, args.repo)


def init(spark, args):
    repo = Repository.init(spark, args.repo, _author(args), chunking.Spec(pattern=args.pattern, seed=args.seed))
    print(f"Initialized empty repository in {args.repo}\nOn branch main at {repo.get_head()[0][:12]}")


def log(spark, args):
    for name, c in _open(spark, args).log(args.ref, args.max_count):
        when = datetime.fromtimestamp(c.timestamp, UTC).strftime("%Y-%m-%d %H:%M:%S")
        print(f"commit {name}\nAuthor: {c.author}\nDate:   {when}\n\n    {c.message}\n")


def import_sqlite(spark, args):
    def tell(p: imports.Progress) -> None:
        if not p.table:
            print(f"written: {p.all_rows} rows in {p.all_seconds:.1f} s, {p.all_rows / max(p.all_seconds, 1e-9):.0f} rows/s")
        else:
            print(f"{p.table}: {p.rows} rows, {p.all_rows} in all" if p.rows else f"{p.table}: empty, skipped")

    commit, counts = imports.import_database(_open(spark, args), args.database, args.tables, merge=args.merge, message=args.message, author=_author(args), progress=tell)
    print(f"Committed {commit[:12]}: {sum(counts.values())} rows")


def dump(spark, args):
    n = 0
    for r in scans.ordered(_open(spark, args).snapshot(args.ref).entries(args.prefix)).toLocalIterator():
        print(f"{r['key']} => {r['value']}")
        n += 1
    print(f"{n} entries")


def show_diff(spark, args):
    events = _open(spark, args).diff(args.old, args.new, args.prefix)
    for r in scans.ordered(events, limit=args.limit).toLocalIterator():
        if r["change_type"] == diff.ADDED:
            print(f"+ {r['key']} => {r['new_value']}")
        elif r["change_type"] == diff.DELETED:
            print(f"- {r['key']} => {r['old_value']}")
        else:
            print(f"M {r['key']}: {r['old_value']} => {r['new_value']}")
    n = diff.summary(events).first()
    print(f"{n['added']} added, {n['deleted']} deleted, {n['modified']} modified, {n['total']} in total")


def db_diff(spark, args):
    repo = _open(spark, args)
    found, old, new = repo.db_diff(args.old, args.new, args.tables), repo.snapshot(args.old), repo.snapshot(args.new)
    for sign, names, at in (("+", found.added, new), ("-", found.removed, old)):
        for t in names:
            print(f"{sign} table {t} ({at.count_rows(t)} rows; {', '.join(at.tables[t].columns)})")
    for name, t in found.changed().items():
        print(f"~ table {name}: {t.summary()}")
        for r in t.columns().collect():
            print(f"    {r['column']}: {r['changes']} ({r['pct']:.1f} %)")
        if args.verbose:
            for r in t.rows.orderBy(*[F.col(f"`{c}`") for c in new.tables[name].primary_key]).limit(10).collect():
                print(f"    {r['status']} {r.asDict(recursive=True)}")
    print(", ".join(f"{n} rows {k}" for k, n in found.totals().items()) if found.has_changes else "no changes")


def print_tree(spark, args):
    snap = _open(spark, args).snapshot(args.ref)
    print(f"{args.prefix}root {snap.root}")
    for r in snap.stats().orderBy("is_leaf").collect():
        print(f"{args.prefix}{'leaves' if r['is_leaf'] else 'internal nodes'}: {r['n']}, {r['average_bytes']:.0f} bytes on average, {r['entries']} entries")
    if args.verbose:
        for r in snap.edges().orderBy(F.desc("level"), "parent_hash", "ord").toLocalIterator():
            print(f"{args.prefix}{'  ' * r['level']}{r['parent_hash'][:12]} -> {r['child_hash'][:12]} {r['separator'] or '_'}")
        for r in stats.histogram(snap.leaves(), "n_bytes").orderBy("lo").collect():
            print(f"{args.prefix}{r['label']:>20} {r['n']:>6} {r['pct']:5.1f} % {'#' * round(r['pct'] / 2)}")


def commonality(spark, args):
    n = graph.commonality_totals(_open(spark, args).commonality(args.left, args.right)).first()
    print(f"only {args.left}: {n['left_only']}\nonly {args.right}: {n['right_only']}\nboth: {n['both']} ({n['both_pct']:.1f} % of {n['total']})")


def get(spark, args):
    found = _open(spark, args).snapshot(args.ref).get(args.key)
    if found is None:
        raise LookupError(f"no such key: {args.key}")
    print(found)


def set_(spark, args):
    draft = _open(spark, args).draft()
    draft.set({args.key: args.value})
    print(f"Committed {draft.commit(f'Set {args.key} = {args.value}', _author(args))[:12]}")


def gc(spark, args):
    n = _open(spark, args).gc(dry_run=args.dry_run)
    print(f"{n['total']} leaves, {n['reachable']} reachable, {n['garbage']} {'would be ' if args.dry_run else ''}removed")


def branch(spark, args):
    repo = _open(spark, args)
    if args.name:
        repo.create_branch(args.name, args.start)
        repo.checkout(args.name)
        print(f"Created and switched to branch {args.name}")
        return
    current = repo.get_head()[1]
    for name, at in sorted(repo.list_branches().items()):
        print(f"{'*' if name == current else ' '} {name} {at[:12]}")


def checkout(spark, args):
    _open(spark, args).checkout(args.ref)
    print(f"Switched to branch {args.ref}")


def _remote(spark, args) -> Repository:
    known = remotes.load_file(args.config) if args.config else {}
    return known[args.remote].open(spark) if args.remote in known else Repository(spark, args.remote)


def push(spark, args):
    n = _open(spark, args).push(_remote(spark, args), args.force)
    print(f"Pushed {n['commits']} commits, {n['leaves']} leaves")


def pull(spark, args):
    n = _open(spark, args).pull(_remote(spark, args), force=args.force)
    print(f"Pulled {n['commits']} commits, {n['leaves']} leaves")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--repo", default=".palimpsest")
    top.add_argument("--author", default="")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Command, *arguments: tuple) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or name))
        for flags, options in arguments:
            p.add_argument(*flags, **options)
        p.set_defaults(run=run)

    a = lambda *flags, **options: (flags, options)
    command("init", init, a("--pattern", type=float, default=0.01), a("--seed", type=int, default=42))
    command("log", log, a("ref", nargs="?"), a("--max-count", type=int))
    command("import-sqlite", import_sqlite, a("database"), a("--tables", nargs="*"), a("--message"), a("--merge", action="store_true"))
    command("dump", dump, a("--ref", default="HEAD"), a("--prefix", default=""))
    command("diff", show_diff, a("old", nargs="?", default="HEAD~"), a("new", nargs="?", default="HEAD"), a("--prefix", default=""), a("--limit", type=int))
    command("db-diff", db_diff, a("old", nargs="?", default="HEAD~"), a("new", nargs="?", default="HEAD"), a("--tables", nargs="*"), a("--verbose", action="store_true"))
    command("print-tree", print_tree, a("ref", nargs="?", default="HEAD"), a("--verbose", action="store_true"), a("--prefix", default=""))
    command("commonality", commonality, a("left", nargs="?", default="HEAD~"), a("right", nargs="?", default="HEAD"))
    command("get", get, a("key"), a("--ref", default="HEAD"))
    command("set", set_, a("key"), a("value"))
    command("gc", gc, a("--dry-run", action="store_true"))
    command("branch", branch, a("name", nargs="?"), a("start", nargs="?"))
    command("checkout", checkout, a("ref"))
    command("push", push, a("remote"), a("--config"), a("--force", action="store_true"))
    command("pull", pull, a("remote"), a("--config"), a("--force", action="store_true"))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(spark or session(), args)
    except (ValueError, LookupError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
