"""One query per operator on the driver's tables, with SQL that gives the same rows where there is any."""
