"""Sources and sinks that are Spark data sources."""
import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from arpent.operators import quality, reconstruct, zones
from arpent.plans.standin import table
from arpent.sources import files, published, unknown

SF = "/root/testdata/sf0.001"


def _plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.fixture()
def supplier(spark):
    return table(spark, SF, "supplier").select(*(F.col(c).cast("string") for c in table(spark, SF, "supplier").columns)).collect()


def _csv(rows, sep, end="\n"):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in f'{sep}"\n') else v
    return end.join(sep.join(map(quoted, r)) for r in [list(rows[0].asDict()), *rows]) + end


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("pack", ["plain", "gzip", "zip", "ranges"])
def test_unknown_table(spark, tmp_path, supplier, sep, pack):
    text = ("﻿" if sep == ";" else "") + _csv(supplier, sep, "\r\n" if sep == "|" else "\n")
    path = tmp_path / "data"  # the name says nothing
    if pack == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.pdf", "no")
            z.writestr("a/table.CSV", text)
            z.writestr("b.txt", "other;table\n1;2\n")
    else:
        path.write_bytes(gzip.compress(text.encode()) if pack == "gzip" else text.encode())
    got = unknown.read_unknown(spark, f"file://{path}", **({"split_bytes": 20} if pack == "ranges" else {}))
    assert got.columns == list(supplier[0].asDict()) and _plain(got.collect()) == _plain(supplier)
    assert (got.rdd.getNumPartitions() > 5) == (pack == "ranges")


def test_unknown_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.csv").write_text('x;y;x;\n1;"two;\n""lines""";9\n;z\n\n')
    (tmp_path / "b" / "c").write_bytes(gzip.compress(b"y,z,x\nq,w,e\n"))
    (tmp_path / "_hidden").write_text("k\n1\n")
    with zipfile.ZipFile(tmp_path / "d.bin", "w") as z:
        z.writestr("1.txt", "x|y\n5|6\n")
        z.writestr("2.csv", "y|x\n7|8\n")
        z.writestr("empty.csv", "")
    got = unknown.read_unknown(spark, f"file://{tmp_path}", members="all")
    assert got.columns == ["x", "y"] and got.rdd.getNumPartitions() == 5
    assert set(map(tuple, got.collect())) == {("1", 'two;\n"lines"'), (None, "z"), ("e", "q"), ("5", "6"), ("8", "7")}
    assert unknown.read_unknown(spark, f"file://{tmp_path}").count() == 4


def test_unknown_table_refuses(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="3 fields"):
        unknown.read_unknown(spark, f"file://{tmp_path}/long.csv").collect()
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(Exception, match="no header"):
        unknown.read_unknown(spark, f"file://{tmp_path}/none.csv").collect()
    with pytest.raises(Exception, match="absent"):
        unknown.read_unknown(spark, f"file://{tmp_path}/absent").collect()
    with zipfile.ZipFile(tmp_path / "z", "w") as z:
        z.writestr("a.pdf", "x")
    with pytest.raises(Exception, match="no member"):
        unknown.read_unknown(spark, f"file://{tmp_path}/z").collect()


def _files(spark, *rows):
    return spark.createDataFrame(list(rows), "prefix string, extension string, content binary, more int")


def test_published_twice_has_equal_names(spark, tmp_path):
    rows = [(f"t{k % 7}", "json", bytes([k % 11]) * k, k) for k in range(60)] + [("same", "bin", b"x", 0), ("same", "bin", b"x", 1), ("none", "bin", None, 0)]
    one = published.publish(_files(spark, *rows).repartition(6), f"file://{tmp_path}/one", {"source": "é"}).collect()
    two = published.publish(_files(spark, *rows[::-1]).repartition(3), f"file://{tmp_path}/two").collect()
    assert _plain(one) == _plain(two) and len(one) == 62
    assert sorted(os.listdir(tmp_path / "one")) == sorted([r["name"] for r in one] + ["manifest.json"])
    assert json.loads((tmp_path / "one" / "manifest.json").read_text())["source"] == "é"
    held = {r["name"]: bytes(r["content"]) for r in published.read_published(spark, f"file://{tmp_path}/one").collect()}
    assert set(held.values()) == {r[2] or b"" for r in rows}


def test_failed_task_leaves_nothing(spark, tmp_path):
    fails = F.when(F.col("more") == 77, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    rows = _files(spark, *((f"t{k}", "bin", b"y" * k, k) for k in range(100))).repartition(5)
    first = published.publish(rows.where("more < 3"), f"file://{tmp_path}/site").collect()
    with pytest.raises(Exception, match="lost"):
        published.publish(rows.withColumn("content", fails), f"file://{tmp_path}/site")
    assert sorted(os.listdir(tmp_path / "site")) == sorted([r["name"] for r in first] + ["manifest.json"])
    assert _plain(published.read_manifest(spark, f"file://{tmp_path}/site").collect()) == _plain(first)


@pytest.mark.parametrize("limits", [{"most_files": 9}, {"most_bytes": 8}])
def test_too_large_a_build_is_not_published(spark, tmp_path, limits):
    rows = _files(spark, *((f"t{k}", "bin", b"y" * k, k) for k in range(10)))
    with pytest.raises(Exception, match="files of at most"):
        published.publish(rows, f"file://{tmp_path}/site", **limits)
    assert os.listdir(tmp_path / "site") == []


def test_damaged_file_is_found(spark, tmp_path):
    published.publish(_files(spark, ("a", "txt", b"good", 0)), f"file://{tmp_path}/site")
    name = next(n for n in os.listdir(tmp_path / "site") if n.startswith("a-"))
    (tmp_path / "site" / name).write_bytes(b"bad")
    with pytest.raises(Exception, match="damaged"):
        published.read_published(spark, f"file://{tmp_path}/site").collect()


HEAD = "id_mutation,date_mutation,nature_mutation,valeur_fonciere,code_commune,nom_commune,type_local,surface_reelle_bati,nombre_pieces_principales,id_parcelle,adresse_numero,adresse_nom_voie"
LINES = [
    '2021-1,2021-03-01,Vente,"300000,50",75101,Paris 1,Appartement,50,2,75101000AB0001,1,RUE X',
    '2021-1,2021-03-01,Vente,"300000,50",75101,Paris 1,Appartement,50,2,75101000AB0001,1,RUE X',
    '2021-1,2021-03-01,Vente,"300000,50",75101,Paris 1,Dépendance,None,0,75101000AB0001,1,RUE X',
    "2021-2,2021-03-01,Vente en l'état futur d'achèvement,300000.5,75101,Paris 1, Maison ,80,4,75101000AC0002,2,RUE Y",
    "2021-3,2021-02-01,Vente,300000.50,75101,Paris 1,Maison,90,4,75101000AC0002,2,RUE Y",
    "2021-4,2021-02-01,Echange,250000,75101,Paris 1,Maison,90,4,75101000AC0002,2,RUE Y",
    "2021-5,2021-02-02,Vente,250000,75101,Paris 1,Local industriel. commercial ou assimilé,90,0,75101000AC0002,2,RUE Y",
    "2021-0,2021-02-01,Vente,300000.50,75101,Paris 1,Appartement,40,1,75101000AC0003,3,RUE Z",
]


def test_from_source_file_to_zones(spark, tmp_path):
    """Eight lines of a source file: sales, their rules, and the extremes of a zone under text ids."""
    (tmp_path / "full.csv").write_text("\n".join([HEAD, *LINES]) + "\n")
    lines = files.typed_lines(files.read_lines(spark, f"file://{tmp_path}/full.csv"))
    sales = reconstruct.reconstruct(lines)
    got = {r["sale_id"]: (r["price"], r["property_type"], r["nature"], r["n_repeats"], r["n_outbuildings"], r["section"], r["address"]) for r in sales.collect()}
    assert got == {
        "2021-1": (300000.5, "Apartment", "Sale", 1, 1, "75101000AB", "1 Rue X"), "2021-2": (300000.5, "House", "Off-plan sale", 0, 0, "75101000AC", "2 Rue Y"),
        "2021-3": (300000.5, "House", "Sale", 0, 0, "75101000AC", "2 Rue Y"), "2021-4": (250000.0, "House", "Echange", 0, 0, "75101000AC", "2 Rue Y"), "2021-0": (300000.5, "Apartment", "Sale", 0, 0, "75101000AC", "3 Rue Z"),
    }
    clean = quality.survivors(sales)
    assert {(r["sale_id"], r["state"]) for r in clean.collect()} == {("2021-0", "Old"), ("2021-1", "Old"), ("2021-2", "New"), ("2021-3", "Old")}
    top = zones.extremes(clean, "commune").first()
    # equal prices: the earlier day, there the first in the file, though its id is larger
    assert (top["max_sale"], top["min_sale"], top["max_area"], top["max_type"], str(top["max_date"])) == ("2021-3", "2021-3", 90.0, "House", "2021-02-01")
    blank = zones.extremes(clean.withColumn("price", F.lit(None).cast("double")), "commune").first()
    assert blank["zone"] == "75101" and blank["max_sale"] is None


def test_lines_without_their_order_are_refused(spark):
    with pytest.raises(ValueError, match="_ord"):
        files.typed_lines(spark.createDataFrame([("1",)], "id_mutation string"))


def test_removals_name_the_malformed_line(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# who asked\n\n2021-01-02;75101; 1 Rue X ; 2\n")
    assert [tuple(map(str, r)) for r in files.read_removals(spark, f"file://{tmp_path}/r.txt").collect()] == [("2021-01-02", "75101", "1 Rue X ; 2")]
    (tmp_path / "r.txt").write_text("# who asked\n\n2021-01-02;7510;1 Rue X\n")
    with pytest.raises(Exception, match="line 3: 2021-01-02;7510;1 Rue X"):
        files.read_removals(spark, f"file://{tmp_path}/r.txt").collect()
