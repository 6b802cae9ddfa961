"""Registered queries with the SQL that checks them.

Every area module holds ``QUERIES`` (name -> function of session and data folder) and
``ORACLES`` (name -> SQL over the same tables).
"""
