"""Operators on metered time series and on vector updates of many clients, as Spark plans."""
