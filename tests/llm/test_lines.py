"""The edit join against all pairs, and the documents it leaves."""

import os
import random
import tracemalloc
import uuid

import pytest

from usagelens.llm import common, lines


def edited(text, times, draw):
    letters = list(text)
    for _ in range(times):
        kind, at = draw.randrange(3), draw.randrange(len(letters) + 1)
        if kind == 0:
            letters.insert(at, draw.choice("abé𝒳"))
        elif at < len(letters):
            letters[at: at + 1] = [] if kind == 1 else [draw.choice("abé𝒳")]
    return "".join(letters)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def ends_off(a, b):
    """The texts without what they have in common at their ends; their distance stays."""
    while a and b and a[-1] == b[-1]:
        n = min(len(a), len(b), 1024)
        n = n if a[-n:] == b[-n:] else 1
        a, b = a[:-n], b[:-n]
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    return a, b


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_bands_and_keys_find_all_close_pairs(distance):
    draw = random.Random(distance)
    left = ["".join(draw.choice("abé d") for _ in range(draw.randrange(0, 45))) for _ in range(800)]
    right = [edited(x, draw.randrange(0, 2 * distance + 3), draw) for x in left]
    want = [plain(a, b) <= distance for a, b in zip(left, right)]
    assert lines.within_distance(left, right, distance, cells=2_000).tolist() == want
    for a, b, close in zip(left, right, want):
        if close and min(len(a), len(b)) > distance:
            who, key, index = lines.segment_keys([a, b], distance)
            keys = {(w, i): set(key[(who == w) & (index == i)].tolist()) for w in (0, 1) for i in (True, False)}
            assert keys[0, True] & keys[1, False] or keys[1, True] & keys[0, False]


def brute(rows, distance, min_chars, near_chars):
    found = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(lines.split_lines(t) if t else [""])]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    near = sorted({x for _, _, x in found if len(x) >= near_chars})
    for i, a in enumerate(near):
        for b in near[i + 1:]:
            if abs(len(a) - len(b)) <= distance and plain(*ends_off(a, b)) <= distance:
                up[root(a)] = root(b)
    groups = {}
    for d, i, x in found:
        groups.setdefault(root(x) if len(x) >= min_chars else (d, i), []).append((d, i))
    return {place: min(group) for group in groups.values() for place in group}


def corpus():
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(5, 60))).strip() for _ in range(12)]
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(edited(draw.choice(base), draw.choice([0, 0, 1, 2, 4]), draw) for _ in range(5))))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "  " + base[0] + " \r\n" + "x" * 70_000), (104, "y" + "x" * 69_999)]


def test_classes_equal_all_pairs(documents):
    rows = corpus()
    got = lines.line_classes(documents(rows), 2, min_chars=5, near_chars=12).collect()
    want = brute(rows, 2, 5, 12)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in got} == want
    assert len(got) == len(want) and all(r["kept"] == (want[r["doc_id"], r["line_no"]] == (r["doc_id"], r["line_no"])) for r in got)


def test_documents_lose_repeated_lines_only(documents):
    rows = [(1, "first common line here\nonly in one of them"), (2, "first common line here"), (3, "own line of the third\nfirst common line hers"),
            (4, None), (5, ""), (6, "short\nshort")]
    docs = documents(rows)
    left = lines.without_repeats(docs, lines.line_classes(docs, near_chars=12))
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {
        1: rows[0][1], 3: "own line of the third", 4: None, 5: "", 6: "short\nshort"}


def test_empty_table_and_repeated_rows(documents):
    assert lines.line_classes(documents([])).count() == 0
    twice = lines.line_classes(documents([(1, "the same line twice over")] * 2)).collect()
    assert [(r["class_doc_id"], r["class_line_no"]) for r in twice] == [(1, 0)] * 2


def test_null_and_repeated_ids_lose_their_own_lines_only(documents):
    rows = [(1, "a line found more than once\na first line of its own"), (1, "a second text's only line here\nanother line, of the second"),
            (None, "a line found more than once\nwhat follows without an id"), (None, "yet another text without any id"), (2, "a line found more than once")]
    docs = documents(rows)
    left = lines.unrepeated(docs)
    assert left.columns == docs.columns
    found = sorted(line for r in left.collect() for line in r["text"].split("\n"))
    assert found == sorted({line for _, text in rows for line in text.split("\n")})


def test_short_lines_link_by_the_bounds_of_the_queries(documents):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(n)).strip() for n in range(1, 34) for _ in range(2)]
    rows = [(d, "\n".join(edited(draw.choice(base), draw.choice([0, 0, 1, 1, 2, 3]), draw) for _ in range(6))) for d in range(120)]
    rows += [(200, "Contact us\nTop"), (201, "Contact us.\nTop\nToy"), (202, "a heading of thirty characters\n\n"), (203, "a heading of thirty character")]
    got = lines.line_classes(documents(rows), **lines.WHOLE).collect()
    found = [(d, i, x) for d, t in rows for i, x in enumerate(lines.split_lines(t) if t else [""])]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    distinct = sorted({x for _, _, x in found if x})
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            edits = min(2, min(len(a), len(b)) // 5)
            if abs(len(a) - len(b)) <= edits and plain(a, b) <= edits and root(a) != root(b):
                up[root(a)] = root(b)
    groups = {}
    for d, i, x in found:
        groups.setdefault(root(x) if x else (d, i), []).append((d, i))
    want = {place: min(group) for group in groups.values() for place in group}
    assert {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in got} == want
    assert want[201, 0] == want[200, 0] and want[201, 1] == want[200, 1] != want[201, 2] and want[203, 0] == want[202, 0]


def test_keys_of_many_lines_are_made_in_little_memory():
    draw = random.Random(5)
    many = ["".join(draw.choices("abcdefghij ", k=60)) for _ in range(30_000)]
    tracemalloc.start()
    found = 0
    for part in lines._portions(many):
        found += len(lines.segment_keys(part, 2)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > len(many) and peak < 25_000_000, peak


def test_texts_come_to_python_in_short_batches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def noted(run):
        def inner(batches):
            def each():
                for batch in batches:
                    open(f"{folder}/{uuid.uuid4().hex}-{batch.nbytes}", "w").close()
                    yield batch
            yield from run(each())
        return inner

    monkeypatch.setattr(lines, "trimmed", noted)
    docs = spark.range(0, 96, 1, 1).selectExpr("id AS doc_id", "concat('this is the line of document ', id DIV 2, repeat(' ', 200000)) AS text")
    got = lines.line_classes(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(96)) and sum(r["kept"] for r in got) < 49
    sizes = [int(name.split("-")[1]) for name in os.listdir(folder)]
    # Texts are read four times.
    assert sum(sizes) > 4 * 96 * 200_000 and max(sizes) < common.BATCH_BYTES + 500_000, max(sizes)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_memory_goes_back_before_a_task_takes_more(monkeypatch):
    said = []
    monkeypatch.setattr(common, "_give_back", lambda: said.append("back"))

    def run(batches):
        for batch in batches:
            said.append(batch)
            yield batch

    list(common.trimmed(run)(iter([1, 2])))
    assert said == ["back", 1, 2, "back"]
