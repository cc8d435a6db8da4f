"""gustframe: sensor analytics and power regression as Spark DataFrame plans.

Subpackages: ``functions`` (column expressions), ``sources`` (readers, writers,
role views), ``operators`` (profiles, bins, windows, ranks, joins,
evaluation), ``plans`` (ML stages, models and the registered queries),
``streaming`` (intentionally empty).
"""

__version__ = "0.1.0"
