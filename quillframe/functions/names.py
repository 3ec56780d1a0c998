"""Names of functions and how many arguments they take: fixed values of the dialect."""

ALIASES = {"SUBSTR": "SUBSTRING", "CEILING": "CEIL", "TRUNC": "TRUNCATE", "POW": "POWER", "CONVERT": "CAST"}

MANY = 1 << 30
SCALARS = {
    "UPPER": (1, 1), "LOWER": (1, 1), "TRIM": (1, 1), "LTRIM": (1, 1), "RTRIM": (1, 1), "LENGTH": (1, 1), "LENGTH_CHAR": (1, 1), "SUBSTRING": (2, 3), "LEFT": (2, 2), "RIGHT": (2, 2),
    "INSTR": (2, 2), "CONCAT": (2, MANY), "REPLACE": (3, 3), "TRANSLATE": (3, 3), "LPAD": (2, 3), "RPAD": (2, 3), "COALESCE": (1, MANY), "ISNULL": (2, 2), "NULLIF": (2, 2), "GREATEST": (2, MANY),
    "LEAST": (2, MANY), "REGEXP_LIKE": (2, 3), "REGEXP_REPLACE": (3, 5), "REGEXP_SUBSTR": (2, 3), "ROUND": (1, 2), "FLOOR": (1, 2), "CEIL": (1, 2), "TRUNCATE": (1, 2), "ABS": (1, 1), "POWER": (2, 2),
    "SQRT": (1, 1), "MOD": (2, 2), "CAST": (2, 2), "FORMAT": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "DAYOFWEEK": (1, 1), "QUARTER": (1, 1), "WEEK": (1, 1), "DATE_FORMAT": (2, 2),
    "DATEDIFF": (2, 2), "DATE_ADD": (3, 3), "LAST_DAY": (1, 1), "CURRENT_DATE": (0, 0), "CURRENT_TIMESTAMP": (0, 0),
}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "VAR_POP", "VAR_SAMP", "STDDEV_POP", "STDDEV_SAMP", "MEDIAN", "MODE"}
SERVER = {"TODAY": (0, 0), "NOW": (0, 0), "LOGINUSER": (0, 0), "PRIMARY_ORGANIZATION": (0, 0)}
RELATIVE = {"YESTERDAY", "TOMORROW", "FROM_TODAY", "THIS_WEEK", "LAST_WEEK", "NEXT_WEEK", "THIS_MONTH", "LAST_MONTH", "NEXT_MONTH", "THIS_YEAR", "LAST_YEAR", "NEXT_YEAR"}
CLOCK = {"NOW", "TODAY", "MONTH_START", "NEXT_MONTH_START"}
