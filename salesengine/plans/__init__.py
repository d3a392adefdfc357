"""Query plans: the reference's business questions as lazy DataFrame jobs."""
