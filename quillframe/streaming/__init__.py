"""The dialect has no streaming constructs.  Compiled filters, projections and joins with
static tables are plain DataFrame operations, so they apply to a streaming DataFrame that is
registered in the catalog as well."""
