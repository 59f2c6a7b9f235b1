"""wirebook: OT/ICS network behaviour analytics as Spark DataFrame operators."""
