"""Registered queries over the tables of a data folder, each with the SQL it is compared with."""
