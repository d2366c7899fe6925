"""Enforcement analytics on Spark: facts of cases and notices with their offenders, agencies, legislation and offences."""
