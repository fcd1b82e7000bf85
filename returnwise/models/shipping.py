"""Let executors run this package's numeric helpers without having the package installed."""

from __future__ import annotations

from pyspark import cloudpickle

from returnwise.functions import numeric
from returnwise.models import families

for _module in (numeric, families):
    cloudpickle.register_pickle_by_value(_module)
