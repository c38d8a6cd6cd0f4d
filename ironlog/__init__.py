"""Strength-log analytics as Spark DataFrame transformations.

Every public operator takes DataFrames and returns a lazy DataFrame, for all
athletes and all lifts in one job.  Nothing here collects, loops over groups on
the driver or runs Python per row.
"""
