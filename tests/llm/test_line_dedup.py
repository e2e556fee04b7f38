from __future__ import annotations

import random

from logtide.llm.line_dedup import clean_lines, drop_repeated_lines, remove_repeated_lines


def brute(rows):
    """Every window in order of id and position; later equal ones cover their lines."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(lines[i] for i in filled[k:k + 3])
            if window in seen:
                gone.update((k, k + 1, k + 2))
            seen.add(window)
        runs = sum(1 for k in gone if k - 1 not in gone)
        kept = None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in {filled[k] for k in gone})
        out[doc_id] = (len(filled), len(gone), runs, kept)
    return out


def result(docs):
    return {r.row.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept) for r in remove_repeated_lines(docs).collect()}


def test_against_every_window(make_docs):
    draw = random.Random(3)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "", " ", "d e"]) + ("x" if draw.random() < 0.2 else "")
                          for _ in range(draw.randint(0, 25)))) for i in range(80)]
    assert result(make_docs(rows).repartition(6)) == brute(rows)


def test_edge_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc\nd"), (5, "z\na\nb\nc\nd\n\n"), (6, "\n".join(["same"] * 400))]
    assert result(make_docs(rows, starts="x", row="y", text2="z")) == brute(rows)
    assert result(make_docs([])) == {}


def test_rows_of_one_id(make_docs):
    """Equal rows are one document; another text under the same id is compared with it."""
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nq"), (None, "k\nl\nm"), (3, "k\nl\nm")]
    found = sorted(((r.row.doc_id or 0), r.kept) for r in remove_repeated_lines(make_docs(rows)).collect())
    assert found == [(0, "k\nl\nm"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "q"), (3, "")]


def test_stage_keeps_columns_and_drops_emptied_documents(make_docs):
    docs = make_docs([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nc\nrest"), (4, None), (5, "")], kept="mine")
    out = drop_repeated_lines(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.text, r.n_chars, r.kept) for r in out.collect()) == [
        (1, "a\nb\nc", 5, "mine"), (3, "rest", 4, "mine"), (4, None, None, "mine"), (5, "", 0, "mine")]


def test_windows_merge():
    assert clean_lines("a\n\nb\nc\nd\ne", [0, 1]) == ("\ne", 5, 4, 1)
    assert clean_lines("a\nb\nc\nd\ne\nf\ng", [0, 4]) == ("d", 7, 6, 2)
