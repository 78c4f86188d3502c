"""Products: CSV, JSON, Markdown, manifests, and SVG maps."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOURS = {"HH": "#d7191c", "LL": "#2c7bb6", "HL": "#fdae61", "LH": "#abd9e9", "NS": "#d9d9d9", "Island": "#969696", "Hot": "#d7191c", "Cold": "#2c7bb6"}
RAMP = ("#440154", "#414487", "#2a788e", "#22a884", "#7ad151", "#fde725")
MISSING = "lightgray"


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header; nested columns become JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes])
    folder = f"{path}.parts"
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
    part = next(Path(folder).glob("part-*.csv"), None)
    if part is None:
        Path(path).write_text(",".join(df.columns) + "\n", encoding="utf-8")
    else:
        shutil.move(part, path)
    shutil.rmtree(folder)
    return path


def write_json(data: dict, path: str) -> str:
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return path


def sha256(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while raw := f.read(block):
            digest.update(raw)
    return digest.hexdigest()


def digest_tree(spark, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of the files of a distributed input."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(config: str | None, inputs: list[str], outputs: list[str], **run) -> dict:
    """What went in and came out, with digests and versions; the manifest itself is not listed."""
    told = lambda paths: {os.path.basename(p): {"sha256": sha256(p), "bytes": os.path.getsize(p)} for p in paths if os.path.isfile(p)}
    return {
        "created_utc": datetime.now(UTC).isoformat(),
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "config": told([config]) if config else {},
        "inputs": told(inputs),
        "outputs": told(outputs),
        **run,
    }


def map_layer(df: DataFrame, id_column: str, class_column: str, column: str = "geom") -> DataFrame:
    """``(id, class, colour, geom)``: what a map draws.  Null classes get the missing colour."""
    known = F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(v))])
    colour = F.coalesce(F.element_at(known, F.col(class_column).cast("string")), F.lit(MISSING))
    return df.select(F.col(id_column).alias("id"), F.col(class_column).cast("string").alias("class"), colour.alias("colour"), F.col(column).alias("geom"))


def class_colours(layer: DataFrame, classes: list[str]) -> DataFrame:
    """Colours along the ramp for ordered classes."""
    pairs = {c: RAMP[min(len(RAMP) - 1, round(k * (len(RAMP) - 1) / max(1, len(classes) - 1)))] for k, c in enumerate(classes)}
    chosen = F.lit(MISSING)
    for c, colour in pairs.items():
        chosen = F.when(F.col("class") == c, colour).otherwise(chosen)
    return layer.withColumn("colour", chosen)


def write_svg_map(layer: DataFrame, path: str, title: str, size: int = 800) -> str:
    """An SVG of polygon layers; shapes stream through the driver."""
    from ..operators.geometry import measures, read_wkb

    bounds = measures(layer).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    x0, y0, x1, y1 = (float(v or 0) for v in bounds)
    scale = size / max(x1 - x0, y1 - y0, 1e-12)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -30 {size} {size + 30}"><text x="4" y="-8" font-size="18">{_escaped(title)}</text>\n')
        for r in layer.toLocalIterator():
            if r.geom is None:
                continue
            rings = [ring for p in read_wkb(bytes(r.geom)) for ring in p]
            d = " ".join("M" + "L".join(f"{(x - x0) * scale:.2f},{(y1 - y) * scale:.2f}" for x, y in ring) + "Z" for ring in rings)
            f.write(f'<path d="{d}" fill="{r.colour}" fill-rule="evenodd" stroke="#333" stroke-width="0.5"><title>{_escaped(f"{r.id}: {r["class"]}")}</title></path>\n')
        f.write("</svg>\n")
    return path


def write_svg_points(points: DataFrame, path: str, title: str, size: int = 800) -> str:
    """An SVG of ``points(x, y, class, colour)``; points stream through the driver."""
    x0, y0, x1, y1 = (float(v or 0) for v in points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
    scale = (size - 20) / max(x1 - x0, y1 - y0, 1e-12)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -30 {size} {size + 30}"><text x="4" y="-8" font-size="18">{_escaped(title)}</text>\n')
        for r in points.toLocalIterator():
            if r.x is not None and r.y is not None:
                f.write(f'<circle cx="{10 + (r.x - x0) * scale:.2f}" cy="{10 + (y1 - r.y) * scale:.2f}" r="4" fill="{r.colour}" stroke="#333" stroke-width="0.4"><title>{_escaped(str(r["class"]))}</title></circle>\n')
        f.write("</svg>\n")
    return path


def signed_colours(column: str, most: float) -> Column:
    """Colours of a diverging ramp from ``-most`` to ``most``."""
    share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(column) / F.lit(most or 1.0)))
    faded = F.lower(F.lpad(F.hex((F.lit(230) * (1 - F.abs(share))).cast("long")), 2, "0"))
    return F.when(F.col(column).isNull(), MISSING).when(share < 0, F.concat(F.lit("#"), faded, faded, F.lit("e6"))).otherwise(F.concat(F.lit("#e6"), faded, faded))


def write_svg_bars(rows: list[tuple[str, str, float]], path: str, title: str, width: int = 800) -> str:
    """An SVG of bars ``(group, label, value)``, one below the other."""
    most = max((v for _, _, v in rows), default=0.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {40 + 24 * len(rows)}"><text x="4" y="20" font-size="18">{_escaped(title)}</text>']
    groups = sorted({g for g, _, _ in rows})
    for k, (group, label, value) in enumerate(rows):
        y, colour = 34 + 24 * k, RAMP[round(groups.index(group) * (len(RAMP) - 1) / max(1, len(groups) - 1))]
        out.append(f'<text x="4" y="{y + 14}" font-size="13">{_escaped(f"{group} {label}")}</text><rect x="240" y="{y}" width="{(width - 330) * value / most:.1f}" height="18" fill="{colour}"/>')
        out.append(f'<text x="{246 + (width - 330) * value / most:.1f}" y="{y + 14}" font-size="13">{value:.4f}</text>')
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*out, "</svg>\n"]))
    return path


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def regression_report(summary: list[dict], coefficients: list[dict], classical: list[dict], spatial: list[dict], vif: list[dict], alpha: float) -> str:
    """Markdown with the tables, a bullet per model and weights, and what the tests cannot show."""

    def table(rows: list[dict]) -> str:
        if not rows:
            return "_no rows_\n"
        names = list(rows[0])
        cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]) + "\n"

    out = ["# Regression report\n"]
    for title, rows in (("Models", summary), ("Coefficients", coefficients), ("Classical diagnostics", classical), ("Spatial diagnostics", spatial), ("Variance inflation", vif)):
        out += [f"## {title}\n", table(rows)]
    out.append("## Flags\n")
    for r in spatial:
        flagged = [c[:-2] for c in r if c.endswith("_p") and r[c] is not None and r[c] < alpha]
        out.append(f"- {r['model']} with {r['weights']}: " + (f"significant at {alpha}: {', '.join(flagged)}" if flagged else f"nothing significant at {alpha}"))
    out.append("\n## Limits\n\n- The tests describe residual dependence under the given weights; they do not choose a model by themselves.\n- Robust errors do not remove spatial dependence.\n- Influence marks units to look at, not units to drop.\n")
    return "\n".join(out)
