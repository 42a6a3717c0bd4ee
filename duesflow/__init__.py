"""Shared-building accounts on Spark: imports, billing, payments, reports.

Every public function takes DataFrames and returns DataFrames; none of them
runs an action unless its docstring says so.
"""
