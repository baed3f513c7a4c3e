"""Notice intelligence on Spark: standardise, extract, link, match, alert and search public notices."""
