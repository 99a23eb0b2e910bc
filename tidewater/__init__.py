"""PySpark jobs for public investment disclosures and daily prices."""
