"""Scan, decode, gate, merge and stream hand-written transmission files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardflow.operators.latest import last_wins
from wardflow.plans import quality
from wardflow.sources import delimited as dl
from wardflow.sources import fixed_width as fw
from wardflow.sources import store
from wardflow.sources.layouts import ADMIN, WEEKLY
from wardflow.streaming.incremental import ingest, stream_lines


def weekly(version="M1D", nda="000000012", week="092024", um="UM1", entry="01032024", birth="31121950", das=(), n_das=None, cut=0):
    layout = next(x for x in WEEKLY.layouts if x.version == version)
    chars = [" "] * layout.fixed_length
    def put(name, value):
        f = layout.field(name)
        if f is not None:
            chars[f.start - 1 : f.end] = value.ljust(f.width)[: f.width]
    for name, value in {
        "version_format_rhs_groupe": version, "finess_epmsi": "680000009", "numero_admin_sejour": nda, "numero_semaine": week, "numero_unite_medicale": um,
        "date_entree_um": entry, "date_naissance": birth, "code_gme": "0875UC1", "jours_hors_weekend": "11111", "jours_weekend": "01",
        "n1_nb_das": f"{len(das):02d}" if n_das is None else n_das, "n2_nb_csarr": "000", "n3_nb_csar": "000", "n4_nb_ccam": "00",
    }.items():
        put(name, value)
    line = "".join(chars) + "".join(d.ljust(8) for d in das)
    return line[: len(line) - cut] if cut else line


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"\r\n".join(x.encode("latin-1") for x in lines) + b"\r\n")


def test_scan_numbers_and_encoding(spark, tmp_path):
    write(tmp_path / "d", "a.txt", ["é premier", "", "trois", "   "])
    write(tmp_path / "d", "b.txt", ["un"])
    rows = fw.read_lines(spark, str(tmp_path / "d")).collect()
    got = sorted((r.source_file[-5:], r.line_no, r.line) for r in rows)
    assert got == [("a.txt", 1, "é premier"), ("a.txt", 3, "trois"), ("a.txt", 4, "   "), ("b.txt", 1, "un")]


def test_line_numbers_over_splits(spark, tmp_path):
    write(tmp_path / "d", "a.txt", [f"ligne {i}" for i in range(1, 5001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = fw.read_lines(spark, str(tmp_path / "d"))
        assert lines.rdd.getNumPartitions() >= 1
        wrong = lines.where(F.col("line") != F.concat(F.lit("ligne "), F.col("line_no").cast("string"))).count()
        assert wrong == 0 and lines.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def decoded(spark, tmp_path, lines):
    write(tmp_path / "d", "r.txt", lines)
    scan = fw.read_lines(spark, str(tmp_path / "d"))
    return scan, fw.decode(scan, WEEKLY).orderBy("line_no").collect()


def test_decode_versions_and_faults(spark, tmp_path):
    lines = [
        weekly(das=["A123", "B45"]), weekly("M1C", das=["C1"]), weekly("M1B"), weekly().replace("M1D", "M9Z"), weekly(cut=4),
        weekly() + "xx", weekly(n_das="  "), weekly(n_das="ab"), weekly(birth="00000000"), weekly(birth="31022020"), weekly(birth="3102202x"), "   ",
    ]
    scan, rows = decoded(spark, tmp_path, lines)
    by_line = {r.line_no: r for r in rows}
    assert set(by_line) == {1, 2, 3, 5, 6, 7, 8, 9, 10, 11}
    assert [(x.seq, x.code_das) for x in by_line[1].das] == [(1, "A123"), (2, "B45")] and by_line[1].errors == []
    assert by_line[2].record_version == "M1C" and by_line[2].n3_nb_csar is None and [x.code_das for x in by_line[2].das] == ["C1"]
    assert by_line[3].code_gme == "0875UC" and by_line[3].numero_semaine == "092024" and by_line[3].errors == []
    assert any("record length" in e for e in by_line[5].errors) and any("record length" in e for e in by_line[6].errors)
    assert by_line[7].n1_nb_das is None and by_line[7].das == [] and by_line[7].errors == []
    assert by_line[8].n1_nb_das is None and any(e.startswith("n1_nb_das") for e in by_line[8].errors)
    assert by_line[9].date_naissance is None and by_line[9].errors == []
    assert by_line[10].date_naissance == "2020-02-31" and by_line[10].errors == []
    assert by_line[11].date_naissance is None and any("date_naissance" in e for e in by_line[11].errors)
    assert sorted(r.line_no for r in fw.rejected(scan, WEEKLY).collect()) == [4, 12]


def test_gate(spark, tmp_path):
    write(tmp_path / "d", "ok.txt", [weekly(), weekly(nda="000000013")])
    write(tmp_path / "d", "warn.txt", [weekly(), weekly(birth="3102202x")])
    write(tmp_path / "d", "block.txt", [weekly(), weekly(um="    ")])
    write(tmp_path / "d", "other.txt", ["nothing known here"])
    scan = fw.read_lines(spark, str(tmp_path / "d"))
    gate = quality.file_gate(quality.record_verdicts(scan, WEEKLY))
    got = {r.source_file.rsplit("/", 1)[1]: (r.status, r.blocked) for r in gate.collect()}
    assert got == {"ok.txt": ("accepted", False), "warn.txt": ("to_confirm", False), "block.txt": ("blocked", True), "other.txt": ("no_known_version", True)}
    first = gate.where(F.col("source_file").endswith("block.txt")).first().first_blocking
    assert first == "line 2: link field numero_unite_medicale is missing"
    batch = quality.batch_gate(gate, gate.limit(0).select("source_file"), confirmed=True).first()
    assert not batch.promote


def test_last_wins_keeps_incomplete_keys(spark):
    rows = spark.createDataFrame(
        [("a", 1, "f1", 1, "old"), ("a", 1, "f2", 1, "new"), ("a", None, "f1", 2, "x"), ("a", None, "f2", 2, "y")],
        "k string, d int, source_file string, line_no int, v string",
    )
    for data in (rows, rows.union(rows)):  # a reload does not multiply the incomplete ones
        got = sorted(r.v for r in last_wins(data, ["k", "d"], ["source_file", "line_no"]).collect())
        assert got == ["new", "x", "y"]


def test_valuation_csv(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    head = "FINESS;NUMADMIN;NUMSEMAINE;NUMRHS;HOSP;NUMSEMAINE;NV_CHAIN;GMELIB;MNT_BR_GMT"
    (folder / "680000009.2025.12.SMR.VisualValoSejours.csv").write_bytes((head + "\n680000009;24;202510;001;P;10;.;Séjour à 5 €;12.5\n;;;;;;;;\n").encode("cp1252"))
    (folder / "680000009.2026.04.SMR.VisualValoSejours.csv").write_text("FINESS;NUMADMIN;MNT_BR_SUPP_CANCERO\n680000009;25;7\n")
    (folder / "680000009.2027.04.SMR.VisualValoSejours.csv").write_text("FINESS;AUTRE\n680000009;1\n")
    rows, rejected = dl.read_valuation(spark, str(folder))
    got = {r.numero_admin_sejour: r for r in rows.collect()}
    assert set(got) == {"24", "25"} and [("2027" in r.source_file, r.unknown) for r in rejected.collect()] == [(True, ["AUTRE"])]
    a, b = got["24"], got["25"]
    assert (a.numero_semaine, a.numero_semaine_htp, a.nv_chain, a.montant_br_gmt, a.campagne, a.libelle_gme) == ("202510", "10", None, 12.5, 2025, "Séjour à 5 €")
    assert (b.montant_br_supp_cancero, b.montant_br_gmt, b.campagne) == (7.0, None, 2026)


def test_stream_equals_batch(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), list(WEEKLY.key), ["file_time", "source_file", "line_no"], ["finess_epmsi", "iso_year"])
    def run():
        ingest(stream_lines(spark, str(tmp_path / "d")), WEEKLY, table, str(tmp_path / "c")).awaitTermination()
    write(tmp_path / "d", "1.txt", [weekly(das=["A1"]), weekly(nda="000000013")])
    run()
    write(tmp_path / "d", "2.txt", [weekly(das=["B2"])])
    run()
    run()
    rows = {r.numero_admin_sejour: [x.code_das for x in r.das] for r in table.read(spark).collect()}
    assert rows == {"000000012": ["B2"], "000000013": []}


def test_stream_keeps_rejected_lines_and_messages(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), list(WEEKLY.key), ["file_time", "source_file", "line_no"], ["finess_epmsi", "iso_year"])
    log = store.ErrorLog(str(tmp_path / "log"))
    good = weekly(das=["A1"])
    write(tmp_path / "d", "1.txt", [good, good[:10] + "M9Z" + good[13:], good[:-1]])
    for _ in range(2):
        ingest(stream_lines(spark, str(tmp_path / "d")), WEEKLY, table, str(tmp_path / "c"), log=log).awaitTermination()
    messages = [r.message for r in log.current(spark).collect()]
    assert sum(m.startswith("unknown version") for m in messages) == 1 and sum(m.startswith("record length") for m in messages) == 1


def test_headers_are_resolved_in_the_plan(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    files = {
        "a.csv": "FINESS;NUMADMIN;NUMSEMAINE;NUMSEMAINE\r\n1;2;3;4\r\n\r\n;;.; \r\n",  # the second of a name has its own column
        "b.csv": 'NUMADMIN;FINESS\n"7;8";9\n5\n6;7;8;9\n',  # quotes, a short line and a long one
        "c.csv": "FINESS;NUMSEMAINE;NUMSEMAINE;NUMSEMAINE;X\n1;2;3;4;5\n", "d.csv": "FINESS\n", "e.csv": "",
    }
    for name, text in files.items():
        (folder / name).write_bytes(text.encode("cp1252"))
    rows, rejected = dl.read_valuation(spark, str(folder))
    got = [(r.source_file[-5:], r.finess_epmsi, r.numero_admin_sejour, r.numero_semaine, r.numero_semaine_htp) for r in rows.collect()]
    assert len(got) == 4 and set(got) == {("a.csv", "1", "2", "3", "4"), ("b.csv", "9", "7;8", None, None), ("b.csv", None, "5", None, None), ("b.csv", "7", "6", None, None)}
    assert [(r.source_file[-5:], r.unknown) for r in rejected.collect()] == [("c.csv", ["NUMSEMAINE", "X"])]
    gate = {r.source_file[-5:]: (r.n_rows, r.unknown, r.blocked) for r in quality.valuation_gate(rows.groupBy("source_file").agg(F.count("*").alias("n_rows")), rejected).collect()}
    assert gate == {"a.csv": (1, None, False), "b.csv": (3, None, False), "c.csv": (0, "NUMSEMAINE, X", True)}


def faulty_files():
    """Five files with faults of every kind; files share records, so the order of loads matters."""
    das = lambda k: [f"D{k}{i}" for i in range(k)]
    good = [[weekly(nda=f"{n:09d}", um=f"U{k}", das=das(k)) for n in range(6)] for k in range(5)]
    files = {}
    for k, lines in enumerate(good):
        shared = weekly(nda="000000777", das=das(k + 1))
        bad = [weekly(nda="000000050", n_das="ab"), weekly(nda="000000051", birth="3102202x"), weekly(nda="000000052", cut=4, das=["X1"]), lines[0][:10] + "M9Z" + lines[0][13:]]
        files[f"{k}.txt"] = [*lines, "", shared, *bad[: k + 1], bad[0]]
    return files


def loaded(spark, table, log):
    rows = {(r.finess_epmsi, r.numero_admin_sejour, r.numero_semaine, r.numero_unite_medicale): (r.source_file[-5:], r.line_no, [x.code_das for x in r.das], r.errors) for r in table.read(spark).collect()}
    messages = sorted((r.source_file[-5:], r.line_no, r.ordinal, r.block, r.item, r.message) for r in log.current(spark).collect())
    return rows, messages


def tables_in(folder):
    return store.Table(str(folder / "t"), list(WEEKLY.key), ["source_file", "line_no"], ["finess_epmsi", "iso_year"]), store.ErrorLog(str(folder / "log"))


def test_killed_and_replayed_stream_equals_one_batch_load(spark, tmp_path):
    """Batches that fail between the table and the log, and ones written twice, leave what one load of all files leaves."""
    for name, lines in faulty_files().items():
        write(tmp_path / "d", name, lines)
    table, log = tables_in(tmp_path / "batch")
    scan = fw.read_lines(spark, str(tmp_path / "d"))
    records = fw.decode(scan, WEEKLY)
    table.upsert(records.withColumn("iso_year", F.substring("numero_semaine", 3, 4)).drop("line"))
    log.append(fw.error_rows(records, scan, WEEKLY), scan, 1)
    want = loaded(spark, table, log)
    assert len(want[1]) == sum(k + 2 for k in range(4)) + 5  # the last file has four kinds of fault, one of them twice
    assert {m[5].split(":")[0] for m in want[1]} >= {"n1_nb_das", "date_naissance", "record length", "unknown version M9Z"}
    assert len({m[:3] for m in want[1]}) == len(want[1])  # file, line and ordinal are a key

    table, log = tables_in(tmp_path / "stream")
    append, failures = log.append, {1, 2}

    def failing(errors, files, load_id):
        if load_id in failures:
            failures.discard(load_id)
            if load_id == 2:
                append(errors, files, load_id)  # the batch is done, only its end is not recorded
            raise RuntimeError("killed")
        append(errors, files, load_id)

    log.append = failing
    for attempt in range(3):
        stream = ingest(stream_lines(spark, str(tmp_path / "d"), maxFilesPerTrigger="2"), WEEKLY, table, str(tmp_path / "c"), log=log)
        if attempt < 2:
            with pytest.raises(Exception, match="killed"):
                stream.awaitTermination()
        else:
            stream.awaitTermination()
    assert not failures and loaded(spark, table, log) == want


def test_partition_codes_keep_their_zeros(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), ["f", "k"], ["o"], ["f", "y"], {"y": "int"})
    rows = spark.createDataFrame([("010000001", 2024, 1, 1), ("010000001", 2024, 1, 2), ("110000001", 2023, 1, 1)], "f string, y int, k int, o int")
    for _ in range(2):
        table.upsert(rows)
    assert sorted(tuple(r) for r in table.read(spark).select("f", "y", "k", "o").collect()) == [("010000001", 2024, 1, 2), ("110000001", 2023, 1, 1)]


@pytest.mark.parametrize("value,message", [("123", None), ("", "missing"), ("XXXX", "not numeric")])
def test_insured_number(spark, value, message):
    got = spark.range(1).select(quality.insured_number_warning(F.lit(value)).alias("m")).first().m
    assert (got is None) if message is None else message in got
    assert ADMIN.layouts[0].fixed_length == 470


def test_an_establishment_leaves(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), ["f", "k"], ["o"], ["f", "y"])
    rows = spark.createDataFrame([("010000001", "2024", 1, 1), ("010000001", "2023", 2, 2), ("110000001", "2023", 1, 1)], "f string, y string, k int, o int")
    table.upsert(rows)
    log = store.ErrorLog(str(tmp_path / "log"))
    errors = spark.createDataFrame([("x", "a.txt", 1, "bad"), ("x", "b.txt", 1, "bad"), ("x", "b.txt", 1, "bad")], "format string, source_file string, line_no long, message string")
    log.append(errors, errors, 1)
    assert table.drop(spark, "010000001") and not table.drop(spark, "999")
    log.forget(errors.where("source_file = 'b.txt'"), 2)
    assert [tuple(r) for r in table.read(spark).select("f", "y", "k").collect()] == [("110000001", "2023", 1)]
    assert [r.source_file for r in log.current(spark).collect()] == ["a.txt"]
    with pytest.raises(ValueError, match="partition code"):
        table.drop(spark, "../x")


def test_messages_of_items_equal_those_of_one_by_one(spark, tmp_path):
    """A block that is right as a whole is not judged item by item; what is wrong still gives each message."""
    rng = random.Random(7)
    numbers, dates = ["01", " 1", "  ", "1 ", "x1", "-1", "1é"], ["01022024", " " * 8, "00000000", "0102 024", "ABCDEFGH", " 1022024"]
    (block,) = [b for b in WEEKLY.layouts[0].blocks if b.name == "csarr"]
    lines, expected = [], {}
    for i in range(60):
        n, items, wrong = rng.choice([0, 1, 2, 5, 300]), [], []
        for k in range(n):
            item = [" "] * block.width
            for f in block.fields:
                if f.kind in "ND":
                    text = rng.choice(numbers if f.kind == "N" else dates) if i % 3 == 0 and rng.random() < 0.1 else ("01" if f.kind == "N" else "01022024")
                    item[f.start - 1 : f.end] = text
                    clean = text.strip(" ")
                    bad = clean != "" and not re.fullmatch(r"-?[0-9]+" if f.kind == "N" else r"0+|[0-9]{8}", clean)
                    wrong += [f"csarr[{k + 1}].{f.name}: not a {'number' if f.kind == 'N' else 'DDMMYYYY date'} (raw={text})"] if bad else []
            items.append("".join(item))
        head = list(weekly(nda=f"{i:09d}"))
        head[176:179] = f"{n:03d}"
        lines.append("".join(head) + "".join(items))
        expected[i + 1] = wrong
    scan, rows = decoded(spark, tmp_path, lines)
    assert {r.line_no: list(r.errors) for r in rows} == expected
    assert all([x.seq for x in r.csarr] == list(range(1, len(r.csarr) + 1)) for r in rows) and max(len(r.csarr) for r in rows) == 300
    messages = fw.error_rows(fw.decode(scan, WEEKLY), scan, WEEKLY)
    assert messages.count() == sum(map(len, expected.values())) > 10
    # the messages are made once, not once more in a filter of their own
    plan = messages._jdf.queryExecution().optimizedPlan().toString()
    assert not any("transform(" in line for line in plan.split("\n") if line.strip(" :+-").startswith("Filter"))


def test_stream_knows_its_files_without_reading_them_again(spark, tmp_path):
    """a batch's files come from the stored sizes of its splits; a file without a message is current as well."""
    table = store.Table(str(tmp_path / "t"), list(WEEKLY.key), ["file_time", "source_file", "line_no"], ["finess_epmsi", "iso_year"])
    log = store.ErrorLog(str(tmp_path / "log"))
    write(tmp_path / "d", "1.txt", [weekly(das=["A1"]), weekly(nda="000000013")])
    write(tmp_path / "d", "2.txt", ["", ""])
    seen = []
    append = log.append
    log.append = lambda errors, files, load: (seen.append(files._jdf.queryExecution().optimizedPlan().toString()), append(errors, files, load))
    ingest(stream_lines(spark, str(tmp_path / "d")), WEEKLY, table, str(tmp_path / "c"), log=log).awaitTermination()
    assert len(seen) == 1 and "parquet" in seen[0] and "LogicalRDD" not in seen[0]
    assert sorted(r.source_file[-5:] for r in spark.read.parquet(log.loads).collect()) == ["1.txt", "2.txt"]
    assert table.read(spark).columns[-3:] == ["file_time", "finess_epmsi", "iso_year"] and table.read(spark).where("file_time is null").count() == 0
