"""Usage and adoption reporting on Spark: operators, readers and KPI tables."""
