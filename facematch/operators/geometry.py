"""Face alignment and image dimensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: where eyes, nose and mouth corners lie in an aligned face of 112 x 112.
TEMPLATE = ((30.2946, 51.6963), (65.5318, 51.5014), (48.0252, 71.7366), (33.5493, 92.3655), (62.7299, 92.2041))


def with_affine(df: DataFrame, points: Column, name: str = "m") -> DataFrame:
    """df with the column ``name``, a struct(a, b, c, d, e, f): the affine map of least squares from five
    points to the template, null if they lie on a line.

    The two coordinates share one 3 x 3 system, solved by Cramer's rule. Its sums are columns before
    its determinants are, so that none is worked out twice.
    """

    def total(terms):
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    at = df.withColumns({f"{prefix}{k}{i}": points[i][k].cast("double") for i in range(5) for k in "xy"})
    xs, ys = [[F.col(f"{prefix}{k}{i}") for i in range(5)] for k in "xy"]
    sums = {"sx": total(xs), "sy": total(ys), "sxx": total([x * x for x in xs]), "sxy": total([x * y for x, y in zip(xs, ys, strict=True)]), "syy": total([y * y for y in ys])}
    for k in (0, 1):
        u = [F.lit(p[k]) for p in TEMPLATE]
        sums |= {f"p{k}": total([x * t for x, t in zip(xs, u, strict=True)]), f"q{k}": total([y * t for y, t in zip(ys, u, strict=True)])}
    summed = at.select(*df.columns, *(c.alias(prefix + k) for k, c in sums.items()))
    s = {k: F.col(prefix + k) for k in sums}
    n = F.lit(5.0)
    whole = summed.withColumn(prefix, det(s["sxx"], s["sxy"], s["sx"], s["sxy"], s["syy"], s["sy"], s["sx"], s["sy"], n))
    out = []
    for k in (0, 1):
        p, q, r = s[f"p{k}"], s[f"q{k}"], F.lit(sum(t[k] for t in TEMPLATE))
        out += [det(p, s["sxy"], s["sx"], q, s["syy"], s["sy"], r, s["sy"], n), det(s["sxx"], p, s["sx"], s["sxy"], q, s["sy"], s["sx"], r, n), det(s["sxx"], s["sxy"], p, s["sxy"], s["syy"], q, s["sx"], s["sy"], r)]
    solved = F.when(F.abs(F.col(prefix)) >= 1e-9, F.struct(*((x / F.col(prefix)).alias(c) for x, c in zip(out, "abcdef", strict=True))))
    return whole.withColumn(name, solved).select(*df.columns, name)


def fit(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) of an image brought down to ``most`` on its longer edge; smaller ones stay.

    The shorter edge is cut to a whole number, 1 at least, as the imaging library does that is matched.
    """
    ratio = width.cast("double") / height
    big, wide = F.greatest(width, height) > most, width > height
    least = lambda x: F.greatest(F.lit(1), F.floor(x)).cast("int")
    w = F.when(big, F.when(wide, F.lit(most)).otherwise(least(most * ratio))).otherwise(width).cast("int")
    h = F.when(big, F.when(wide, least(most / ratio)).otherwise(F.lit(most))).otherwise(height).cast("int")
    return F.struct(w.alias("width"), h.alias("height"))
