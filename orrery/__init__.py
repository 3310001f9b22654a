"""orrery: reading-order analytics and corpus preparation as Spark plans."""
