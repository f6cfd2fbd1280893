"""Result sinks: CSV with fixed decimals, Markdown, SVG and HTML of bounded samples."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Fractional columns as text with so many decimals."""
    return df.withColumns({f.name: F.format_string(f"%.{decimals}f", F.col(f.name).cast("double")) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")} or {df.columns[0]: F.col(df.columns[0])})


def write_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    fixed(df, decimals).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, decimals: int = 3, limit: int = 10_000) -> str:
    """A table of a small result; more than limit rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def _sample(points: DataFrame, most: int) -> list:
    """At most ``most`` points, those of least hash of idx."""
    rows = points.select("idx", "x", "y", "z", *(c for c in "rgb" if c in points.columns))
    return rows.orderBy(F.xxhash64("idx"), "idx").limit(most).collect()


def svg(points: DataFrame, title: str, columns: int = 480, pixel: int = 2) -> str:
    """Top view (x to the right, y up): the cloud's box is divided into ``columns`` squares a side, and each square that holds points shows the colour of the highest one. Only squares reach the driver, at most columns ** 2."""
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = (float(v or 0) for v in box)
    edge = max(x1 - x0, y1 - y0) / columns or 1.0
    at = {n: F.least(F.floor((F.col(c) - low) / edge), F.lit(columns - 1)).cast("int").alias(n) for n, c, low in (("u", "x", x0), ("v", "y", y0))}
    squares = points.select(*at.values(), F.struct("z", "idx", "r", "g", "b").alias("p")).where("u is not null and v is not null").groupBy("u", "v").agg(F.max("p").alias("p")).orderBy("v", "u").collect()
    side = columns * pixel
    shapes = "".join(f'<path d="M{s.u * pixel} {side - (s.v + 1) * pixel}h{pixel}v{pixel}h-{pixel}z" fill="#{s.p.r:02x}{s.p.g:02x}{s.p.b:02x}"/>' for s in squares)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -24 {side} {side + 24}"><title>{html.escape(title)}</title><text y="-8">{html.escape(title)}</text>{shapes}</svg>'


def preview_html(points: DataFrame, title: str, most: int = 100_000) -> str:
    """A page that draws a sample on a canvas, rotated by dragging."""
    data = json.dumps([[r.x, r.y, r.z] for r in _sample(points, most)])
    script = "const c=document.querySelector('canvas'),g=c.getContext('2d');let a=0;function d(){g.clearRect(0,0,c.width,c.height);for(const[x,y,z]of P){const u=x*Math.cos(a)-y*Math.sin(a);g.fillRect(c.width/2+S*u,c.height/2-S*z,1,1)}}c.onmousemove=e=>{if(e.buttons){a+=e.movementX/100;d()}};const S=Math.min(c.width,c.height)/2/Math.max(1e-9,...P.map(p=>Math.max(Math.abs(p[0]),Math.abs(p[1]),Math.abs(p[2]))));d()"
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><canvas width=1200 height=900></canvas><script>const P={data};{script}</script>"
