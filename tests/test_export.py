import hashlib
import json

import builders
import numpy as np
from pyspark.sql import functions as F

from orebed import cli
from orebed.codecs import anim, png
from orebed.operators import export, progress, sprites

WHITE = builders.dds("DXT1", 4, 4, bytes.fromhex("ffff0000") + bytes(4))


def container():
    return builders.layered([("diffuse", 4, 4, WHITE), ("bright", 4, 4, b"broken"), ("teamcolor", 4, 4, WHITE), ("normal", 4, 4, WHITE)], [(0, 0, -1, 1, 4, 4)])


def test_exported_files(spark):
    found, _ = sprites.layered_files(spark.createDataFrame([("u/a.anim", container())], "path string, content binary"))
    out = {r.path: bytes(r.content) for r in export.exported(found, ["normal", "bright"], keep_dds=True).collect()}
    assert set(out) == {"u/a_diffuse.png", "u/a_mask.png", "u/a_normal.png", "u/a_diffuse.dds", "u/a_normal.dds", "u/a_bright.dds", "u/a.json"}
    assert (png.decode(out["u/a_normal.png"]) == 255).all() and json.loads(out["u/a.json"])["frames"][0]["offsetX"] == -1
    plain = {r.path for r in export.exported(found, team_colour=False).collect()}
    assert plain == {"u/a_diffuse.png", "u/a.json"}


def test_progress(spark):
    df, seen = progress.observed(spark.range(10), F.col("id") < 4)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 10, "ok": 4, "failed": 6}
    names = spark.createDataFrame([("a" * 40,), ("b" * 41,)], "p string").select(progress.shown_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["a" * 40, "..." + "b" * 37]


def test_crop_beyond_the_edge():
    image = np.full((4, 4, 4), 9, np.uint8)
    part = anim.crop(image, anim.Frame(2, 3, 0, 0, 4, 2))
    assert part.shape == (2, 4, 4) and part[0, :2].min() == 9 and part[1].max() == 0 and part[0, 2:].max() == 0


def test_commands(spark, tmp_path, capsys):
    def run(*argv):
        capsys.readouterr()
        assert cli.main(list(argv)) == 0
        return json.loads(capsys.readouterr().out)

    (tmp_path / "in" / "anim").mkdir(parents=True)
    (tmp_path / "in" / "anim" / "main_003.anim").write_bytes(container())
    (tmp_path / "in" / "anim" / "main_004.anim").write_bytes(b"bad")
    (tmp_path / "m.yaml").write_text("animations/zerg/x: anim/main_003.anim\n")
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    assert run("files", source, "--search", "MAIN") == {"files": 2, "first": ["anim/main_003.anim", "anim/main_004.anim"]}
    assert run("raw", source, "--output", output, "--include", "003")["ok"] == 1 and (tmp_path / "out" / "anim" / "main_003.anim").exists()
    done = run("anim", source, "--output", output, "--names", str(tmp_path / "m.yaml"), "--png")
    assert done["ok"] == 3 and done["rejects"][0][0] == "anim/main_004.anim" and (tmp_path / "out" / "zerg" / "x_diffuse.png").exists()
    assert run("anim", source, "--output", output, "--max-files", "4")["ok"] == 1
    row = {"sprite_name": "x", "expected_output": "zerg/x.json", "sha256_hash": hashlib.sha256((tmp_path / "out" / "zerg" / "x.json").read_bytes()).hexdigest()}
    (tmp_path / "b.json").write_text(json.dumps([row, {**row, "sprite_name": "y", "expected_output": "none.png"}]))
    checked = run("check", output, "--baselines", str(tmp_path / "b.json"))
    assert (checked["total"], checked["passed"], checked["failed"]) == (2, 1, 1) and checked["failed_first"][0] == "MISSING: y"
    assert run("config")["output"]["directory"] == "extracted"
