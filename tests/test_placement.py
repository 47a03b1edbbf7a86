import random
from collections import defaultdict

import pytest

from comarca.functions.text import ACCENTED, PLAIN
from comarca.operators.placement import GRAM, LETTERS_PER_EDIT, place_names, place_rows
from comarca.plans.model import build_model, losses, recover_codes
from tests.test_study import rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(name):
    return " ".join(name.translate(str.maketrans(ACCENTED, PLAIN)).lower().split())


def brute(received, reference, most_edits, margin):
    """Every name against every reference of its block; (block, name) -> (id, edits, outcome)."""
    known = defaultdict(set)
    for block, i, name in reference:
        if block is not None and i is not None and name and plain(name):
            known[block, plain(name)].add(i)
    out = {}
    for block, name in received:
        if block is None or not name or not plain(name):
            continue
        n = plain(name)
        if (block, n) in known:
            ids = known[block, n]
            out[block, n] = (min(ids), 0, "equal") if len(ids) == 1 else (None, 0, "ambiguous")
            continue
        edged = "\1" + n + "\2"
        grams = len({edged[i : i + GRAM] for i in range(len(edged) - GRAM + 1)})
        most = min(most_edits, len(n) // LETTERS_PER_EDIT, (grams - 1) // GRAM - (margin - 1))
        near = [(distance(n, m), i) for (b, m), ids in known.items() if b == block for i in ids] if most > 0 else []
        best = min(near, default=(99, None))
        if best[0] > most:
            out[block, n] = (None, None, "unknown")
        elif sum(d <= best[0] + margin - 1 for d, _ in near) == 1:
            out[block, n] = (best[1], best[0], "placed")
        else:
            out[block, n] = (None, best[0], "ambiguous")
    return out


def misspelt(rng, name):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(name) + 1)
        name = name[:i] + rng.choice(["", "x", "e", " "]) + name[i + rng.randint(0, 1) :]
    return name


@pytest.mark.parametrize("most_edits, margin", [(2, 2), (1, 1), (3, 1)])
def test_equals_all_pairs(spark, most_edits, margin):
    rng = random.Random(most_edits)
    syllables = ["ro", "sa", "rio", "san", "ta", "fe", "cor", "do", "ba", "ñu", " del ", "sur"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    reference = [(rng.choice(["a", "b"]), i, n) for i, n in enumerate(names)]
    reference += [("a", 500, names[0]), ("b", 501, names[0].upper()), ("a", 7, "second name of it"), ("a", None, "x"), (None, 1, "y"), ("a", 9, None)]
    received = [(rng.choice(["a", "b"]), misspelt(rng, rng.choice(names))) for _ in range(500)]
    received += [("a", None), ("b", ""), (None, "rosa"), ("c", names[1]), ("a", "  "), ("a", "z" * 300), ("a", "ab")] + received[:40]
    got = place_names(
        spark.createDataFrame(received, "block string, name string"),
        spark.createDataFrame(reference, "block string, id int, name string"),
        "name", "id", "block", most_edits, margin,
    ).collect()
    want = brute(received, reference, most_edits, margin)
    assert {(r.block, r.name): (r.id, r.edits, r.outcome) for r in got} == want
    assert len(got) == len(want)
    assert {"equal", "placed", "ambiguous", "unknown"} == {o for _, _, o in want.values()}


def test_rows_keep_ids_and_columns(spark):
    found = [(1, 40, "whatever", "x"), (2, None, "Cordba", "y"), (3, None, "Cordba", "y"), (4, None, None, "z"), (5, None, "Paris", None)]
    df = spark.createDataFrame(found, "name int, place int, place_name string, outcome_ string")
    known = spark.createDataFrame([(40, "Rosario"), (41, "Córdoba")], "place int, place_name string")
    got = place_rows(df, known, "place_name", "place")
    assert got.columns == [*df.columns, "outcome"]
    assert {(r.name, r.place, r.outcome) for r in got.collect()} == {
        (1, 40, "given"), (2, 41, "placed"), (3, 41, "placed"), (4, None, "no name"), (5, None, "unknown")
    }
    assert place_rows(df, known.limit(0), "place_name", "place").count() == 5
    assert place_rows(df.limit(0), known, "place_name", "place").count() == 0


def test_registers_with_names_for_codes(spark):
    codes = [("2", "Córdoba", "7", "Río Cuarto"), ("2", "Córdoba", "14", "Marcos Juárez"), ("6", "La Pampa", "1", "Río Cuarto")]
    schools = [
        ("s1", "2", "7", None, None, "X"), ("s2", "2", "S/D", None, "Rio Curto", "X"), ("s3", "?", "?", "Cordova", "marcos  juares", "X"),
        ("s4", "?", "", "La Panpa", "Río Cuarto", "X"), ("s5", "2", "", None, "S/D", "X"), ("s6", "?", "", None, "Río Cuarto", "X"),
        ("s7", "2", "", None, "elsewhere", "X"),
    ]
    place = "prov_code string, prov_name string, dep_code string, dep_name string"
    registers = {
        "codes": spark.createDataFrame(codes, place),
        "population": spark.createDataFrame([("2", "7", "10")], "prov_code string, dep_code string, persons string"),
        "schools": spark.createDataFrame(
            schools, "school_code string, prov_code string, dep_code string, prov_name string, dep_name string, initial string"
        ),
        "libraries": spark.createDataFrame([], "lib_code string, prov_code string, dep_code string, founded string, email string"),
    }
    recovered, report = recover_codes(registers)
    assert rows(report) == {("schools", "given", 1), ("schools", "placed", 2), ("schools", "equal", 1), ("schools", "no name", 2), ("schools", "unknown", 1)}
    assert recovered["schools"].columns == ["school_code", "prov_code", "dep_code", "initial"]
    model = build_model(recovered, {"initial": "Initial"})
    assert rows(model["schools"]) == {("s1", "02007"), ("s2", "02007"), ("s3", "02014"), ("s4", "06001")}
    lost = {(r.register, r.reason): r.n_rows for r in losses(recovered).collect()}
    assert lost["schools", "unplaced"] == 3 and lost["schools", "placed"] == 4
    assert recovered["population"] is registers["population"]
