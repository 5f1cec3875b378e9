"""Split files: the planner, byte ranges, streamed documents, the catalogue and its outputs."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from retort.sources import catalogue, splits


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("seed", range(5))
def test_ranges_give_each_line_once(monkeypatch, seed):
    draw = random.Random(seed)
    for _ in range(200):
        monkeypatch.setattr(splits, "READ_BYTES", draw.choice([1, 2, 3, 7, 50]))
        lines = [bytes(draw.choice(b"ab \r") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 8))]
        data = b"\n".join(lines)
        ends = [0, *sorted(draw.sample(range(len(data) + 1), min(len(data) + 1, draw.randint(0, 3)))), len(data)]
        got = [row for a, b in zip(ends, ends[1:]) for row in splits.lines_between(io.BytesIO(data), a, b)]
        want, at = [], 0
        for line in data.split(b"\n"):
            if at < len(data):
                want.append((at, line))
            at += len(line) + 1
        assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_streamed_documents_equal_the_parser(monkeypatch, seed):
    draw = random.Random(seed)
    items = [1, 123456, -1.5e3, 'a,]"é漢', None, True, {"a": [1, {"b": "]"}]}, [], {}]
    for _ in range(100):
        monkeypatch.setattr(splits, "READ_BYTES", draw.choice([1, 2, 3, 7, 50]))
        document = [draw.choice(items) for _ in range(draw.randint(0, 6))]
        text = json.dumps(document, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        assert [json.loads(e) for e in splits.elements(splits.in_memory(f"\n {text} \n"))] == document
        for broken in (text[:-1], text + "x", text.replace(",", ";", 1), "", " ", "{", '{"a": 1} 2'):
            if not splits.is_json(broken):
                with pytest.raises(ValueError):
                    list(splits.elements(splits.in_memory(broken)))
    assert list(splits.elements(splits.in_memory(' {"a": 1}\n'))) == ['{"a": 1}']


def read(spark, root, size=splits.RANGE_BYTES, **options):
    files = catalogue.catalogue(spark, str(root), ("*.jsonl", "*.json"))
    rows = splits.read_splits(spark, files, range_bytes=size, **options).orderBy("file_no", "ordinal")
    return [json.loads(r[0]) for r in rows.select(F.to_json("record")).collect()]


@pytest.mark.parametrize("size", [5, 64, splits.RANGE_BYTES])
def test_policies_and_order_of_split_files(spark, tmp_path, size):
    put(tmp_path, "1.json", '{"n": 1}\n{"n": 2}\nbad\n{"n": 3}\nbad\n')  # ends at the first bad line
    put(tmp_path, "2.json", '[\n{"n": 4},\n{"n": 5}\n]')
    put(tmp_path, "3.json", '{\n"n": 6\n}')
    put(tmp_path, "4.json", '[{"n": 7}, {"n": 8}]\n')  # a one-line array stays one record
    put(tmp_path, "5.json", "nothing\n")
    put(tmp_path, "6.json", "\n \n")
    put(tmp_path, "7.jsonl", '{"n": 9}\nbad\n\n{"n": 10}')  # bad lines are left out
    put(tmp_path, "8.json", '[\n{"n": 11},\n{"n": 12}\n')  # not closed: left out whole
    many = ["{}" + "\n" * (1 + i % 3) for i in range(300)]
    put(tmp_path, "9.json", "".join(line.replace("{}", f'{{"n": {100 + i}}}') for i, line in enumerate(many)))
    of = lambda *numbers: [{"n": i} for i in numbers]
    rest = of(*range(100, 400))
    assert read(spark, tmp_path, size) == [*of(1, 2, 4, 5, 6), of(7, 8), *of(9, 10), *rest]
    assert read(spark, tmp_path, size, flatten_one_line=True) == [*of(1, 2, 4, 5, 6, 7, 8, 9, 10), *rest]


def test_lines_go_in_ranges_and_documents_in_one(tmp_path):
    lines = put(tmp_path, "a.json", "".join(f'{{"n": {i}}}\n' for i in range(100)))
    document = put(tmp_path, "b.json", "[\n" + ",\n".join(f'{{"n": {i}}}' for i in range(100)) + "]")
    parts = splits.SplitReader([lines, document], {lines: 500}, 200).partitions()
    assert [(p.kind, p.start, p.end) for p in parts] == [("lines", 0, 200), ("lines", 200, 400), ("lines", 400, 500), ("document", 0, 1091)]


def test_catalogue_exclusions(spark, tmp_path):
    for name in ("top.jsonl", "out.jsonl", "a_split_x/1.jsonl", "a_split_x/2.json", "b/c/3.jsonl", "b/c/d/4.jsonl", "old/5.jsonl", "note.txt"):
        put(tmp_path, name, "{}\n")
    root = str(tmp_path)

    def names(**options):
        rows = catalogue.catalogue(spark, root, ("*.jsonl", "*.json"), **options).orderBy("ordinal").collect()
        assert [r["ordinal"] for r in rows] == list(range(1, len(rows) + 1))
        return [r["path"].split(f"{root}/")[1] for r in rows]

    every = ["a_split_x/1.jsonl", "a_split_x/2.json", "b/c/3.jsonl", "b/c/d/4.jsonl", "old/5.jsonl", "out.jsonl", "top.jsonl"]
    assert names() == every
    for spelled in (f"{root}/out.jsonl", f"file:{root}/out.jsonl", f"file://{root}/out.jsonl"):
        assert names(output=spelled) == [n for n in every if n != "out.jsonl"]
    assert names(output=f"{root}/old") == [n for n in every if not n.startswith("old/")]
    assert names(skip_root_level=True) == every[:5]
    assert names(nearest=True) == ["out.jsonl", "top.jsonl"]
    nested = catalogue.catalogue(spark, f"{root}/b", nearest=True)
    assert [r["name"] for r in nested.collect()] == ["3.jsonl"]


def test_one_output_for_several_folders_is_an_error(spark, tmp_path):
    for name in ("full_ar_split_500/1.jsonl", "full_hu_split/1.jsonl"):
        put(tmp_path, name, "{}\n")
    files = catalogue.catalogue(spark, str(tmp_path))
    outputs = [catalogue.plain(r["output"]) for r in catalogue.planned_outputs(files).orderBy("ordinal").collect()]
    assert outputs == [f"{tmp_path}/full_ar.jsonl", f"{tmp_path}/full_hu.jsonl"]
    with pytest.raises(ValueError, match="several folders"):
        catalogue.planned_outputs(files, name="all.jsonl")
    one = catalogue.planned_outputs(files.filter("ordinal = 1"), folder="/x/", name="all.jsonl")
    assert one.first()["output"] == "/x/all.jsonl"
