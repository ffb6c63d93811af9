"""The normal distribution as native column expressions, good to 1e-15.

The distribution function is the rational approximation by Hart with a continued
fraction beyond it; the quantile is algorithm AS 241 by Wichura.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ts import as_col

# Fixed values of the published approximations, highest power first.
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FROM, CENTRE_TO, FAR_FROM = 7.07106781186547, 0.425, 5.0
CENTRE_TOP = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080)
CENTRE_BOTTOM = (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0)
NEAR_TOP = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734)
NEAR_BOTTOM = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0)
FAR_TOP = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720)
FAR_BOTTOM = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def pdf(x: Column | str) -> Column:
    x = as_col(x).cast("double")
    return F.exp(x * x / -2.0) / math.sqrt(2 * math.pi)


def cdf(x: Column | str) -> Column:
    """P(Z <= x); NULL for NULL."""
    x = as_col(x).cast("double")
    far = F.abs(x)
    bell = F.exp(far * far / -2.0)
    fraction = far + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = far + F.lit(k) / fraction
    tail = F.when(far < TAIL_FROM, bell * polynomial(TAIL_TOP, far) / polynomial(TAIL_BOTTOM, far)).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def quantile(p: Column | str) -> Column:
    """The x with P(Z <= x) = p; NULL outside 0 < p < 1."""
    p = as_col(p).cast("double")
    inside = (p > 0) & (p < 1)
    centre = p - 0.5
    square = F.lit(CENTRE_TO * CENTRE_TO) - centre * centre
    root = F.sqrt(-F.log(F.when(inside, F.least(p, F.lit(1.0) - p)).otherwise(F.lit(0.5))))
    near, far = root - 1.6, root - FAR_FROM
    size = F.when(root <= FAR_FROM, polynomial(NEAR_TOP, near) / polynomial(NEAR_BOTTOM, near)).otherwise(polynomial(FAR_TOP, far) / polynomial(FAR_BOTTOM, far))
    value = F.when(F.abs(centre) <= CENTRE_TO, centre * polynomial(CENTRE_TOP, square) / polynomial(CENTRE_BOTTOM, square)).otherwise(F.signum(centre) * size)
    return F.when(inside, value)
