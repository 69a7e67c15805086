"""Wording of flags, reasons and letters. ``{name}`` marks a filled-in column."""

# Factor matching and calculation.
NO_ACTIVE_FACTOR = (
    "No matching factor found for activity_type '{activity_type}' active on {date}"
)
NO_FACTOR_FOR_PLACE = (
    "No factor found matching geography '{geography}' or any fallback hierarchy for activity "
    "'{activity_type}'"
)
RESULT_OVERFLOW = "The result does not fit the ledger: it has more than twelve integer digits."
NO_QUANTITY = "The activity has no quantity."
INCOMPATIBLE_UNITS = (
    "Cannot convert quantity from '{unit}' to factor unit '{denominator}'. Units belong to "
    "incompatible physical dimensions."
)

# Review decisions.
INVALID_CATEGORY = "Invalid category '{category}' for scope {scope}."

# Yearly variance.
DROP_TITLE = "Unexplained {size}% Drop in Scope {scope} Emissions"
DROP_TEXT = (
    "Scope {scope} emissions dropped by {size}% (from {prior} to {current} tCO2e), while "
    "activity quantity only changed by {activity}%. Indicates potentially omitted data sources "
    "or missing calculation records."
)
SURGE_TITLE = "Unexplained {size}% Surge in Scope {scope} Emissions"
SURGE_TEXT = (
    "Scope {scope} emissions surged by {size}% while activity quantity only changed by "
    "{activity}%. Indicates possible unit conversion errors or duplicated records."
)

# Intensity outliers and omitted scopes.
OUTLIER_TITLE = "Emissions Intensity Outlier for {activity_type} (Z={z})"
OUTLIER_TEXT = (
    "Line item has emissions intensity of {intensity} tCO2e/{unit}, which is {z} standard "
    "deviations from mean ({mean})."
)
OMISSION_TITLE = "Omission of Scope {scope} Emissions"
OMISSION_TEXT = (
    "Scope {scope} emissions were reported in baseline period {baseline} ({prior} tCO2e), but "
    "are absent in {year}."
)

# Narrative checks.
NARRATIVE_TITLE = "Greenwashing Alert: Narrative Claim Contradicts Calculation Ledger"
NARRATIVE_TEXT = "Heuristic check flagged potential greenwashing claim."
CONTEXT_CURRENT = (
    "Reporting Period ({year}): Total={total} tCO2e (Scope 1={s1}, Scope 2={s2}, Scope 3={s3})."
)
CONTEXT_BASELINE = (
    "Baseline Period ({year}): Total={total} tCO2e (Scope 1={s1}, Scope 2={s2}, Scope 3={s3}). "
    "Overall YoY Change: {change}."
)

# Eligibility.
INELIGIBLE_NOTES = "N/A (Ineligible)"
SB253_YES = (
    "Entity is eligible: exceeds $1B USD annual revenue threshold (${revenue}) and conducts "
    "business in California."
)
SB253_REVENUE = "Annual revenue (${revenue}) does not exceed $1,000,000,000 threshold"
SB253_NEXUS = "Entity does not conduct business in California"
SB253_NOTES = "Scope 1 & 2 mandatory starting 2026; Scope 3 mandatory starting 2027."
CSRD_YES = (
    "EU large undertaking meeting {met}/3 criteria (Employees: {employees}, Turnover: "
    "€{turnover}, Balance Sheet: €{balance})."
)
CSRD_NO = (
    "EU entity only satisfied {met}/3 criteria for large undertakings (minimum 2 required)."
)
CSRD_NOTES = "ESRS E1 disclosure required annually with statutory audit assurance."
CSRD_FOREIGN_YES = (
    "Non-EU parent entity with EU net turnover (€{turnover}) exceeding €150,000,000 threshold."
)
CSRD_FOREIGN_NO = (
    "Non-EU entity's EU turnover (€{turnover}) does not exceed the €150,000,000 threshold."
)
CSRD_FOREIGN_NOTES = "Non-EU group reporting mandatory from financial year 2028."
GHG_PROTOCOL_YES = (
    "Universal standard available for voluntary and general corporate GHG inventory reporting."
)
GHG_PROTOCOL_NOTES = "Self-determined corporate sustainability reporting cycle."
GATE_REJECTION = "Entity is not eligible to generate {framework} disclosure: {reason}"

# Referential integrity.
CALCULATION_BLOCKED = (
    "Calculation '{id}' is referenced by {count} regulatory disclosure(s) and cannot be deleted."
)
FACTOR_BLOCKED = (
    "EmissionFactor '{id}' is referenced by {count} calculation(s) in the audit ledger and "
    "cannot be deleted."
)

# Supplier letters: template type -> (subject, body). The last one is the default.
OUTREACH_TEMPLATES: dict[str, tuple[str, str]] = {
    "ACTIVITY_DATA_VERIFICATION": (
        "Please check your {year} deliveries of {activity} — {name}",
        "To the sustainability contact at {name},\n\n"
        "our greenhouse gas inventory for {year} lists deliveries of '{activity}' from you. Before "
        "it is closed we would like you to look at the quantities: do they agree with your "
        "invoices? Where they do not, a corrected list is all we need.\n\n"
        "Many thanks,\nCarbon accounting",
    ),
    "REDUCTION_PLEDGE": (
        "Your climate targets, {year} — {name}",
        "To the management of {name},\n\n"
        "'{activity}' bought from you is part of our indirect emissions of {year}. Do you have a "
        "target for lowering yours, and how far did you come in {year}? A published plan or a few "
        "lines in reply are equally welcome.\n\n"
        "Kind regards,\nCarbon accounting",
    ),
    "PRIMARY_EMISSION_FACTOR": (
        "Emission factor for {activity}, {year} — {name}",
        "To the sustainability contact at {name},\n\n"
        "for {year} we had to estimate the emissions of '{activity}' from you with a published "
        "average. A figure of your own would replace it: emissions per unit delivered, with the "
        "unit, the year and, where there is one, the declaration or audit that it comes from.\n\n"
        "Many thanks,\nCarbon accounting and procurement",
    ),
}
