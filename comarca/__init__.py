"""Department facts on Spark: clean registers, model them, ask questions per department.

Every operator takes DataFrames (or Columns) and returns a lazy DataFrame (or
Column). Nothing here collects rows to the driver.
"""
