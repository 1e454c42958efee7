"""Registered queries of the engine: each is a plan from (session, folder of tables) to a DataFrame, with its SQL."""
