"""The source system's own entity: a service-provider profile built from its
bronze tables with this library's operators.

Satellites (each ``lookup_chain`` -> ``nest_many`` -> attach by ``dr_id``):

* address   — addresses, phones, tax ids, weekly contact schedule, reference
              ids, county/link extensions, location variable;
* status    — only rows of the given staff statuses; variables with code
              translations, Medicare/Medicaid identifier maps, primary-care role;
* plan      — networks, status/pcp extensions, term-reason variable; only
              statuses whose contract text is 'active' are kept;
* language, credential (license qualifications, extensions), specialty / taxonomy /
  expertise, training (identifier map, variables), education (a school code
  must match both the school and the hospital table, as in the source).

Hub-level e-mails, social profiles, identifiers, extensions and
accept-new-patient codes come straight from the hub row (one row per
provider: no aggregation needed).  All qualifications are crossed with the
provider's taxonomy codes (optionally with its NPDB list).  The extension lists
stand in ``extension_source_values`` in the source's order.  A credential
extension whose column the given bronze table does not have gives no entries.

Row grain, as in the source: one row per provider x active plan status.  All
provider-level aggregates are built *before* that fan-out, so no array is
duplicated by it (the source aggregated its hub after the fan-out).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from tapestry.functions.arrays import cross_apply, keyed_map, merge_arrays, merge_maps, pick, shape
from tapestry.functions.codes import classify, role_of, translate, yes_no
from tapestry.functions.keys import first_non_empty, full_name, iso_ts, split_code, surrogate_key
from tapestry.operators.lookup import Lookup, attach, lookup_chain
from tapestry.operators.nest import Nest, NestConcat, NestUnion, nest_many
from tapestry.operators.project import bronze
from tapestry.operators.quality import apply_rules, flatten_results
from tapestry.sources.catalog import isin_trimmed

# --- fixed values -----------------------------------------------------------
ID_USE = "usual"
PRIMARY_SCH_TYPE = "HFC2"
ACTIVE_CONTRACT = "active"
SHAPES = {
    "contact": ["reference_id", "id", "entity_type", "telecom_value", "telecom_type", "telecom_use", "telecom_rank",
                "telecom_eff_date", "telecom_exp_date", "contact_name", "contact_address", "contact_telecom_value",
                "contact_telecom_type", "available_all_day", "available_days_of_week", "available_start_time",
                "available_end_time", "intemediary_ind", "intermediary_value", "intermediary_type"],
    "identifier": ["reference_id", "identifier_type", "identifier", "identifier_source", "eff_date", "exp_date"],
    "variable": ["reference_id", "code_id", "code_type", "code_value", "code_description"],
    "extension": ["reference_id", "source_column_name", "source_column_value"],
    "address": ["reference_id", "address_type", "address_use", "address_line_1", "address_line_2", "city", "county",
                "state_province", "postal_code", "zip_code_extension", "country", "longitude", "latitude", "eff_date",
                "exp_date", "confidential_status", "is_handicap_accessible", "locality_code", "address_sch_type",
                "print_in_directory_ind"],
    "phone": ["reference_id", "phone_type", "number", "country_code", "area_code", "extension", "confidential_status"],
    "tax": ["reference_id", "address_reference_id", "tax_id"],
    "primary_phone": ["reference_id", "address_reference_id", "primary_phone"],
    "network": ["reference_id", "plan_id", "name", "type", "parent_payer_network", "eff_date", "exp_date",
                "participation_code", "payer_network_name"],
    "language": ["reference_id", "language_code", "language_code_display", "language_text", "language_proficiency"],
    "id_ref": ["reference_id", "id_type", "id_value", "id_concept", "id_status", "input_field_name"],
    "qualification": ["reference_id", "board_id", "certificate_id", "description", "issue_date", "exp_date", "issuer",
                      "issuer_display", "jurisdiction", "license_category", "license_number", "qualification_code",
                      "qualification_code_display", "qualification_code_system", "qualification_number",
                      "qualification_type", "renew_date", "setting_type", "status", "taxonomy"],
    "npdb": ["qualification_number", "qualification_type"],
    "specialty": ["reference_id", "id", "type", "type_desc", "code_value", "specialty_description", "vendor_name",
                  "primary_ind"],
    "email": ["reference_id", "email_type", "email", "confidential_status"],
    "education": ["reference_id", "cumulative_years_of_training", "degree", "education_type", "end_year", "department",
                  "gpa", "active", "graduated_ind", "school_name", "start_year", "year_of_graduation", "years_in_program"],
    "social": ["reference_id", "type", "url", "active_profile"],
}
# hub identifiers: identifier type -> (hub column, identifier source); all with
# NULL dates except the visa, whose expiry date is kept
HUB_IDENTIFIERS = {
    "Visa": ("visa", "DrName"),
    "UPIN": ("upin", "DrName"),
    "CAQH": ("nudf1", "DrName"),
    "efmg number": ("efmg_no", "DrName"),
    "NPI": ("nationalid", "NPI"),
    "Drname_Medicare": ("medicare", "drname"),
    "Drname_Medicaid": ("medicaid", "drname"),
}
ACCEPTING = ["Accepting New Patients", "Not Accepting New Patients"]
# hub extensions: source column name -> hub column (values written as text)
HUB_EXTENSIONS = {
    "Dr_Title": "drtitle", "pict1": "pict1", "ud7": "ud7", "ud7_date": "ud7_date", "pict2": "pict2", "ud3": "ud3",
    "ud9": "ud9", "Verfac": "verfac", "Beeper": "beeper", "Beeper2": "beeper2", "ud13_date": "ud13_date",
    "ud14_date": "ud14_date", "ud15_date": "ud15_date",
}
EMPLOYMENT_TYPES = {"C": "1099/Contracted", "E": "W-2/Employed"}
# staff-status qualifications: status column -> (description, code display)
STATUS_QUALIFICATIONS = {"udf22": ("Flouride Varnish", "udf22"), "udf21": ("DC Health Check", "udf21"),
                         "udf1": ("EPDST", "udf1")}
# credential extensions: source column name -> (table, column); one list each
CREDENTIAL_EXTENSIONS = {
    "Credent_Code": ("credent", "cd"), "Credent_Link": ("credent", "link"), "Credent_Notes": ("credent", "notes"),
    "Credent_State": ("statelic", "state"), "Credent_Email": ("statelic", "email"),
    "Credent_Verification": ("statelic", "ver_elec"),
}
# education extensions: source column name -> (table, column); one list each
EDUCATION_EXTENSIONS = {
    "Educate_Code": ("educate", "cd"), "cmt1": ("educate", "cmt1"), "Educate_Link": ("educate", "link"),
    "School_Code": ("school", "cd"), "education_notes": ("educate", "notes"), "education_program": ("educate", "cmt1"),
    "school_email": ("school", "email"), "hospital_address_line_1": ("hospital", "addr"),
    "hospital_address_line_2": ("hospital", "addr2"), "hospital_city": ("hospital", "city"),
    "hospital_state": ("hospital", "state"), "hospital_postal_code": ("hospital", "zip"),
    "hospital_country_code": ("hospital", "nation"), "hospital_url": ("hospital", "homehtml"),
    "hospital_contact1": ("hospital", "contact1"), "hospital_phone": ("hospital", "phone"),
    "hospital_fax": ("hospital", "fax"), "hospital_email": ("hospital", "email"), "hospital_comments": ("hospital", "note"),
}
# extension lists in the source's order: names of hub and education extensions, or columns that hold a list
EXTENSION_ORDER = [
    "Verfac", "Dr_Title", "ud7", "ud7_date", "pict1", "pict2", "ud3", "ud9", "Min_Patient_Age", "Max_Patient_Age",
    "ud13_date", "ud14_date", "ud15_date", "status_rec_date_extension", "address_county_extension",
    "address_link_extension", "Educate_Code", "cmt1", "Educate_Link", *CREDENTIAL_EXTENSIONS, "Beeper", "Beeper2",
    "School_Code", "drplan1_status_extension", "drplan1_pcp_spec_extension", "status_rea_date_extension",
    "status_l_secfile_extension", "school_email", "education_program", "education_notes",
    *[name for name in EDUCATION_EXTENSIONS if name.startswith("hospital_")],
]
# hub code columns translated through code tables (for the hub variables)
HUB_CODE_TABLES = {"ethnic": "eth_tab", "ud12": "u12_tab", "pract_cd1": "par_tab"}
# patient age range from two code tables: extension name -> (hub code column, code table)
AGE_EXTENSIONS = {"Min_Patient_Age": ("ud1", "u1_tab"), "Max_Patient_Age": ("ud2", "u2_tab")}
# weekly schedule: day label -> column prefix in the address table
SCHEDULE_DAYS = {"sun": "sun", "mon": "mon", "tue": "tues", "wed": "wednes", "thu": "thurs", "fri": "fri", "sat": "satur"}
TARGET_COLUMNS = [
    "service_provider_id", "source_service_provider_id", "service_provider_id_system", "service_provider_id_type",
    "service_provider_id_type_system", "service_provider_id_use", "service_provider_id_type_display",
    "service_provider_id_period_start", "service_provider_id_period_end", "service_provider_id_assigner",
    "service_provider_id_assigner_display", "name_first_name", "name_middle_name", "name_last_name", "name_prefix_name",
    "name_suffix_name", "service_provider_name_use", "service_provider_name_period_start",
    "service_provider_name_period_end", "alternate_name_name", "address_address_type", "address_address_use",
    "address_address_line_1", "address_address_line_2", "address_city", "address_county", "address_state_province",
    "address_postal_code", "address_zip_code_extension", "address_country", "address_longitude", "address_latitude",
    "address_eff_date", "address_exp_date", "address_confidential_status", "address_locality_code", "other_addresses",
    "primary_phone_number", "secondary_phone_number", "other_phones", "email_email", "other_emails",
    "general_contact_details", "social_profile_social_profile_type", "social_profile_profile_url",
    "other_social_profiles", "pcp_ind", "service_provider_role", "accept_new_patient", "accept_new_patient_from_network",
    "new_patient_characteristic", "base_demographic_gender", "base_demographic_sex", "base_demographic_race",
    "base_demographic_religion", "base_demographic_ethnicity", "base_demographic_marital_status",
    "base_demographic_nationality", "base_demographic_mothers_maiden_name", "base_demographic_citizenship", "national_id",
    "npi", "dea_id", "service_provider_alternate_id", "service_provider_alternate_id_type",
    "service_provider_alternate_id_type_system", "service_provider_alternate_id_type_display", "alternate_id_npi_value",
    "alternate_id_npi_use", "alternate_id_npi_type", "alternate_id_npi_type_system", "alternate_id_clia_value",
    "alternate_id_clia_use", "alternate_id_clia_type", "alternate_id_clia_type_system", "tin", "practice_type",
    "practice_type_display", "location", "location_display", "active", "birth_date_of_birth", "birth_year_of_birth",
    "birth_birthplace", "deceased_deceased_ind", "deceased_deceased_date", "language_language_code", "other_languages",
    "privacy_preferences", "qualifications", "credentialing_practice_type", "credentialing_practice_status",
    "credentialing_provider_status", "credentialing_provider_type", "education", "reviews",
    "provider_participating_code", "networks", "network_tiers", "fee_variation_value", "specialty", "eft",
    "provider_endpoint", "reference_ids", "variable_fields", "source_extension_record_id", "original_source_value",
    "source_name", "source_id", "source_authoritative_ind", "source_timestamp", "identifiers",
    "additional_source_identifiers", "extension_source_values", "data_quality_result",
]
DQ_RULES = """
Service_Provider
    service_provider_id must not be null
    length(npi) must be 10
    npi must not be null
    birth_date_of_birth should be less than now
    birth_date_of_birth should be greater than '1900-01-01'
    length(birth_year_of_birth) must be 4
    base_demographic_gender should be in ['M','F']
    source_id must be service_provider_id
"""
# ---------------------------------------------------------------------------

KEY = "dr_id"


@dataclass(frozen=True)
class SourceValues:
    """What one source system calls things: its name, the staff statuses that are
    loaded, address uses by address type (first list wins) and the texts of its
    status codes."""

    system: str
    staff_statuses: Sequence[str]
    address_use: Mapping[str, Sequence[str]]
    epsdt: Mapping[str, str]
    healthcheck: Mapping[str, str]
    fluoride_varnish: Mapping[str, str]

    @classmethod
    def load(cls, path: str) -> SourceValues:
        """From a JSON file with these names."""
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))


def of(shape_name: str, **values) -> Column:
    """A struct of the named shape: given fields from ``values`` (Columns or
    constants), every other field a NULL string — never a void field."""
    fields = []
    for f in SHAPES[shape_name]:
        v = values.get(f)
        fields.append((f, v if isinstance(v, Column) else (F.lit(v) if v is not None else F.lit(None).cast("string"))))
    return shape(fields)


def _address_satellite(t: dict[str, DataFrame], values: SourceValues) -> DataFrame:
    a = bronze(t["address1"], "address1")
    base, ext = split_code("address1__zip")          # the extension must come from the full code
    a = a.withColumn("address1__zip_extension", ext).withColumn("address1__zip", base)
    a2 = bronze(t["address2"], "address2").select(
        F.col("address2__l_address"), F.substring("address2__tax_id", 1, 10).alias("address2__tax_id"))
    joined = lookup_chain(a, [
        Lookup(bronze(t["addr_arr"], "addr_arr"), "address1__sch_type", "addr_arr__cd", "inner", select=["addr_arr__txt"]),
        Lookup(a2, "address1__link", "address2__l_address", "inner"),
        Lookup(bronze(t["loc_tab"], "loc_tab"), "address1__loc_code", "loc_tab__cd", "left", select=["loc_tab__txt"], trim=True),
    ])
    c = lambda n: F.col(f"address1__{n}")
    ref = surrogate_key(*[c(n) for n in ("dr_id", "sch_type", "addr", "addr2", "city", "state", "zip", "link")])
    joined = joined.withColumn("address_reference_id", ref).withColumnRenamed("address1__dr_id", KEY)
    r = F.col("address_reference_id")
    days = F.array(*[
        of("contact", reference_id=r, id=F.col("addr_arr__txt"), telecom_value=c("fax"), telecom_type="fax",
           available_days_of_week=label,
           available_start_time=first_non_empty(c(f"{p}_s1"), c(f"{p}_s2")),
           available_end_time=first_non_empty(c(f"{p}_e1"), c(f"{p}_e2")))
        for label, p in SCHEDULE_DAYS.items()])
    nests = {
        "other_addresses": Nest(of(
            "address", reference_id=r, address_type="physical", address_use=classify("addr_arr__txt", values.address_use),
            address_line_1=c("addr"), address_line_2=c("addr2"), city=c("city"), county=c("county"),
            state_province=c("state"), postal_code=c("zip"), zip_code_extension=c("zip_extension"), country=c("nation"),
            longitude=c("longitude"), latitude=c("latitude"), eff_date=c("effdate"), exp_date=c("termdate"),
            is_handicap_accessible=c("handicap"), locality_code=c("loc_code"), address_sch_type=c("sch_type"),
            print_in_directory_ind=yes_no(c("udf3"))), "desc"),
        "other_phones": Nest(of("phone", reference_id=r, phone_type="phone", number=c("phone"), extension=c("extension")), "desc"),
        "other_tax_id": Nest(of("tax", reference_id=c("sch_type"), address_reference_id=r, tax_id=F.col("address2__tax_id")), "desc"),
        "primary_phone_array": Nest(of("primary_phone", reference_id=c("sch_type"), address_reference_id=r,
                                       primary_phone=c("phone")), "desc"),
        "address_reference_ids": Nest(of("id_ref", reference_id=r, id_type=F.col("addr_arr__txt"), id_value=c("sch_type"),
                                         input_field_name="cd"), "desc", distinct=True),
        "address_county_extension": Nest(of("extension", reference_id=r, source_column_name="County_Code",
                                            source_column_value=c("countycd")), "desc"),
        "address_link_extension": Nest(of("extension", reference_id=r, source_column_name="Address_Link",
                                          source_column_value=c("link")), "desc"),
        "location_variable": Nest(of("variable", reference_id=r, code_type="Location", code_value=c("loc_code"),
                                     code_description=F.col("loc_tab__txt")), "desc"),
        "general_contact_details": NestUnion(days, "asc", distinct=False),
    }
    return nest_many(joined, KEY, nests)


def _status_satellite(t: dict[str, DataFrame], values: SourceValues, statuses: Sequence[str]) -> DataFrame:
    s = lookup_chain(bronze(t["stfstatu"], "stfstatu").where(isin_trimmed("stfstatu__active123", statuses)), [
        Lookup(bronze(t["sta_tab"], "sta_tab"), "stfstatu__staff_cd", "sta_tab__cd", "left", select=["sta_tab__txt"]),
        Lookup(bronze(t["rec_arr"], "rec_arr"), "stfstatu__active123", "rec_arr__cd", "left", select=["rec_arr__txt"]),
    ]).withColumnRenamed("stfstatu__dr_id", KEY)
    c = lambda n: F.col(f"stfstatu__{n}")

    def variable(code_id, code_type, column, table):
        return Nest(of("variable", code_id=code_id, code_type=code_type, code_value=c(column),
                       code_description=translate(c(column), table, "")), "desc")

    def ident(kind, column):
        return Nest(of("identifier", identifier_type=kind, identifier=c(column), identifier_source="stfstatu"), "desc")

    nests = {
        "status_active_variable": Nest(of("variable", code_type="Active123", code_value=c("active123"),
                                          code_description=F.col("rec_arr__txt")), "desc"),
        "status_staff_variable": Nest(of("variable", code_type="Staff", code_value=c("staff_cd"),
                                         code_description=F.col("sta_tab__txt")), "desc"),
        "status_udf1_variable": variable("udf1", "EPSDT", "udf1", values.epsdt),
        "status_udf21_variable": variable("udf21", "DC Healthcheck", "udf21", values.healthcheck),
        "status_udf22_variable": variable("udf22", "Flouride Varnish", "udf22", values.fluoride_varnish),
        "status_rec_date_extension": Nest(of("extension", source_column_name="Rec_Date",
                                             source_column_value=c("rec_date").cast("string")), "desc"),
        "status_rea_date_extension": Nest(of("extension", source_column_name="Rea_Date",
                                             source_column_value=c("rea_date").cast("string")), "desc"),
        "status_l_secfile_extension": Nest(of("extension", source_column_name="l_secfile",
                                              source_column_value=c("l_secfile")), "desc"),
        "status_medicare_list": ident("Stfstatu_Medicare", "medicare"),
        "status_medicaid_list": ident("Stfstatu_Medicaid", "medicaid"),
        "pcp_codes": Nest(c("pcp_spec"), "asc", distinct=True),
        **{f"status_{col}_qualifications": Nest(of("qualification", description=desc, qualification_code_display=disp,
                                                   status=c(col)), "desc", distinct=True)
           for col, (desc, disp) in STATUS_QUALIFICATIONS.items()},
    }
    agg = nest_many(s, KEY, nests)
    role = role_of("pcp_codes")
    return agg.select(
        "*",
        keyed_map("status_medicare_list", "identifier_type").alias("status_medicare_identifiers"),
        keyed_map("status_medicaid_list", "identifier_type").alias("status_medicaid_identifiers"),
        role["pcp_ind"].alias("pcp_ind"), role["service_provider_role"].alias("service_provider_role"),
    ).drop("status_medicare_list", "status_medicaid_list")


def _plan_satellite(t: dict[str, DataFrame]) -> DataFrame:
    p = lookup_chain(bronze(t["dr_plan1"], "dr_plan1"), [
        Lookup(bronze(t["ins_plan"], "ins_plan"), "dr_plan1__plan_cd", "ins_plan__cd", "left",
               select=["ins_plan__txt", "ins_plan__subname"]),
        Lookup(bronze(t["u3ins_tb"], "u3ins_tb"), "dr_plan1__l_u3ins_tb", "u3ins_tb__cd", "left", select=["u3ins_tb__txt"]),
    ]).withColumnRenamed("dr_plan1__dr_id", KEY).withColumnRenamed("dr_plan1__status", "plan_status")
    c = lambda n: F.col(f"dr_plan1__{n}")
    ref = surrogate_key(c("plan_cd"), c("vstart"), c("eend"), null="")
    nests = {
        "networks": Nest(of("network", reference_id=ref, plan_id=c("plan_cd"), name=F.col("ins_plan__txt"),
                            type=F.col("ins_plan__subname"), parent_payer_network=c("l_par_code"),
                            eff_date=c("vstart").cast("string"), exp_date=c("eend").cast("string")), "desc", distinct=True),
        "drplan1_status_extension": Nest(of("extension", source_column_name="Plan_Status",
                                            source_column_value=F.col("plan_status")), "desc", distinct=True),
        "drplan1_pcp_spec_extension": Nest(of("extension", source_column_name="pcp_spec",
                                              source_column_value=c("pcp_spec")), "desc", distinct=True),
        "drplan1_u3ins_variable": Nest(of("variable", reference_id=ref, code_type="Plan Term Reason",
                                          code_value=F.col("u3ins_tb__cd"), code_description=F.col("u3ins_tb__txt")), "desc"),
    }
    agg = nest_many(p, [KEY, "plan_status"], nests)
    # keep only statuses whose contract text is 'active' (case-insensitive)
    contract = bronze(t["contract_status"], "contract_status")
    return lookup_chain(agg, [Lookup(contract, "plan_status", "contract_status__cd", "inner",
                                     select=["contract_status__txt"],
                                     where=F.lower(F.col("contract_status__txt")) == ACTIVE_CONTRACT)])


def _language_satellite(t: dict[str, DataFrame]) -> DataFrame:
    lang = lookup_chain(bronze(t["dr_lan"], "dr_lan"), [
        Lookup(bronze(t["lan_tab"], "lan_tab"), "dr_lan__lan_cd", "lan_tab__cd", "left", select=["lan_tab__txt"]),
    ]).withColumnRenamed("dr_lan__dr_id", KEY)
    return nest_many(lang, KEY, {"other_languages": Nest(of(
        "language", language_code=F.col("dr_lan__lan_cd"), language_code_display=F.col("lan_tab__txt"),
        language_proficiency=F.col("dr_lan__seq").cast("string")), "asc")})


def _credential_satellite(t: dict[str, DataFrame]) -> DataFrame:
    frames = {name: bronze(t[name], name) for name in ("credent", "statelic")}
    held = {name: f"{tb}__{col}" for name, (tb, col) in CREDENTIAL_EXTENSIONS.items() if f"{tb}__{col}" in frames[tb].columns}
    cr = lookup_chain(frames["credent"], [
        Lookup(bronze(t["lic_arr"], "lic_arr"), "credent__sch_type", "lic_arr__cd", "inner", select=["lic_arr__txt"]),
        Lookup(frames["statelic"], "credent__cd", "statelic__cd", "inner",
               select=["statelic__txt", *[c for c in held.values() if c.startswith("statelic__")]]),
    ]).withColumnRenamed("credent__dr_id", KEY)
    c = lambda n: F.col(f"credent__{n}")
    return nest_many(cr, KEY, {
        "credential_qualifications": Nest(of(
            "qualification", description=c("title"), issue_date=c("issue_dt").cast("string"),
            exp_date=c("lic_date").cast("string"), issuer=F.col("statelic__txt"), issuer_display=F.col("statelic__cd"),
            license_category=F.col("lic_arr__cd"), license_number=c("lic_num"),
            qualification_code_system=F.col("lic_arr__txt"), status=c("status")), "desc", distinct=True),
        **{name: Nest(of("extension", source_column_name=name, source_column_value=F.col(column).cast("string")), "desc")
           for name, column in held.items()},
    })


def _specialty_satellite(t: dict[str, DataFrame]) -> DataFrame:
    sp = lookup_chain(bronze(t["dr_spec"], "dr_spec"), [
        Lookup(bronze(t["spec_tab"], "spec_tab"), "dr_spec__specialty", "spec_tab__cd", "left", select=["spec_tab__txt"]),
    ]).withColumnRenamed("dr_spec__dr_id", KEY)
    c = lambda n: F.col(f"dr_spec__{n}")
    return nest_many(sp, KEY, {
        "specialty_list": Nest(of("specialty", reference_id=F.col(KEY), type="Specialty", code_value=F.col("spec_tab__cd"),
                                  specialty_description=F.col("spec_tab__txt"), primary_ind=c("primspec")), "desc", distinct=True),
        "board_qualifications": Nest(of("qualification", description="Board Certified",
                                        issue_date=c("year_cert").cast("string"), renew_date=c("year_recert").cast("string"),
                                        status=c("bd_cert").cast("string")), "desc", distinct=True),
    })


def _taxonomy_satellite(t: dict[str, DataFrame]) -> DataFrame:
    """Taxonomy entries of providers that have a specialty row.  The provider
    set is made distinct first, so no specialty x taxonomy fan-out is built; a
    provider with specialties but no taxonomy row keeps one all-NULL taxonomy
    entry, as the left join of the source does."""
    providers = bronze(t["dr_spec"], "dr_spec").select(F.col("dr_spec__dr_id").alias(KEY)).distinct()
    tax = bronze(t["taxonomy"], "taxonomy").select(F.col("taxonomy__dr_id").alias("__tax_dr"), "taxonomy__cd")
    j = providers.join(tax, providers[KEY] == tax["__tax_dr"], "left")
    j = lookup_chain(j, [Lookup(bronze(t["taxo_arr"], "taxo_arr"), "taxonomy__cd", "taxo_arr__cd", "left",
                                select=["taxo_arr__descript"], distinct=True)])
    return nest_many(j, KEY, {
        "taxonomy_codes": Nest(F.col("taxonomy__cd"), "asc", distinct=True),
        "taxonomy_spec": Nest(of("specialty", reference_id=F.col(KEY), type="Taxonomy", code_value=F.col("taxonomy__cd"),
                                 specialty_description=F.col("taxo_arr__descript")), "desc", distinct=True),
    })


def _expertise_satellite(t: dict[str, DataFrame]) -> DataFrame:
    ex = lookup_chain(bronze(t["dr_expert"], "dr_expert"), [
        Lookup(bronze(t["exp_tab"], "exp_tab"), "dr_expert__expertise", "exp_tab__cd", "left", select=["exp_tab__txt"]),
    ]).withColumnRenamed("dr_expert__dr_id", KEY)
    code, text = F.col("dr_expert__expertise"), F.col("exp_tab__txt")
    return nest_many(ex, KEY, {
        "expertise_variable": Nest(of("variable", code_type="Expertise", code_value=code, code_description=text), "desc"),
        "expertise_spec": Nest(of("specialty", reference_id=F.col(KEY), type="Expertise", code_value=code,
                                  specialty_description=text), "desc", distinct=True),
    })


def _education_satellite(t: dict[str, DataFrame]) -> DataFrame:
    ed = lookup_chain(bronze(t["educate"], "educate"), [
        Lookup(bronze(t["educ_arr"], "educ_arr"), "educate__sch_type", "educ_arr__cd", "inner", select=["educ_arr__txt"]),
        Lookup(bronze(t["school"], "school"), "educate__cd", "school__cd", "inner",
               select=["school__txt", "school__subname", "school__contact1", "school__contact2", "school__addr",
                       "school__addr2", "school__city", "school__state", "school__zip", "school__nation",
                       "school__email"]),
        Lookup(bronze(t["educ_tab"], "educ_tab"), "educate__degree", "educ_tab__cd", "inner", select=["educ_tab__txt"]),
        # the same code must also be a hospital (both lookups match: D10)
        Lookup(bronze(t["hospital"], "hospital").toDF(*[f"edu_hospital__{x}" for x in t["hospital"].columns]).select(
            "edu_hospital__cd", *[f"edu_hospital__{c}" for tb, c in EDUCATION_EXTENSIONS.values() if tb == "hospital"]),
               "educate__cd", "edu_hospital__cd", "inner"),
    ]).withColumnRenamed("educate__dr_id", KEY)
    c = lambda n: F.col(f"educate__{n}")
    return nest_many(ed, KEY, {
        "education": Nest(of("education", reference_id=F.col(KEY), degree=c("degree"), education_type=F.col("educ_arr__txt"),
                             end_year=F.year(c("tdate").try_cast("date")), department=F.col("school__subname"),
                             school_name=F.col("school__txt"), start_year=F.year(c("fdate").try_cast("date"))),
                          "desc", distinct=True),
        **{f"education_ext_{i}": Nest(of("extension", source_column_name=name,
                                         source_column_value=F.col(f"{'edu_hospital' if tb == 'hospital' else tb}__{col}")
                                         .cast("string")), "desc")
           for i, (name, (tb, col)) in enumerate(EDUCATION_EXTENSIONS.items())},
        "educ_tab_variable": Nest(of("variable", code_type="Education", code_value=c("degree"),
                                     code_description=F.col("educ_tab__txt")), "desc"),
        # both school contacts, concatenated inside the aggregate and sorted
        "school_general_contact_details": NestConcat([
            of("contact", entity_type="School", contact_name=F.col("school__contact1")),
            of("contact", entity_type="School", contact_name=F.col("school__contact2"))], "asc"),
        "other_addresses_school": Nest(of(
            "address", reference_id=F.col(KEY), address_line_1=F.col("school__addr"), address_line_2=F.col("school__addr2"),
            city=F.col("school__city"), state_province=F.col("school__state"),
            postal_code=F.substring("school__zip", 1, 5), country=F.col("school__nation"),
            print_in_directory_ind=F.lit(None).cast("boolean")), "desc", distinct=True),
    })


def _training_satellite(t: dict[str, DataFrame]) -> DataFrame:
    tr = lookup_chain(bronze(t["train"], "train"), [
        Lookup(bronze(t["hospital"], "hospital"), "train__cd", "hospital__cd", "left", select=["hospital__txt"]),
        Lookup(bronze(t["apos_tab"], "apos_tab"), "train__position", "apos_tab__cd", "left", select=["apos_tab__txt"]),
        Lookup(bronze(t["affi_arr"], "affi_arr"), "train__sch_type", "affi_arr__cd", "left", select=["affi_arr__txt"]),
    ]).withColumnRenamed("train__dr_id", KEY)
    c = lambda n: F.col(f"train__{n}")
    ref = surrogate_key(c("position"), c("cd"), null=None)
    agg = nest_many(tr, KEY, {
        "train_identifier_list": Nest(of(
            "identifier", reference_id=ref, identifier_type="Training", identifier=c("position"),
            identifier_source="Provider_Train", eff_date=iso_ts(c("fdate").try_cast("timestamp")),
            exp_date=iso_ts(c("tdate").try_cast("timestamp"))), "desc"),
        "apos_variable": Nest(of("variable", reference_id=ref, code_type="Training Position", code_value=c("position"),
                                 code_description=F.col("apos_tab__txt")), "desc"),
        "hospital_variable": Nest(of("variable", reference_id=ref, code_type="Place of Training",
                                     code_value=F.col("hospital__cd"), code_description=F.col("hospital__txt")), "desc"),
        "affi_arr_variable": Nest(of("variable", reference_id=ref, code_type="Program Type",
                                     code_description=F.col("affi_arr__txt")), "desc"),
    })
    return agg.withColumn("train_identifiers", keyed_map("train_identifier_list", "identifier_type")).drop(
        "train_identifier_list")


def _nullable(dt: DataType) -> DataType:
    if isinstance(dt, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType), True) for f in dt.fields])
    if isinstance(dt, ArrayType):
        return ArrayType(_nullable(dt.elementType), True)
    return dt


def provider_profile(t: dict[str, DataFrame], values: SourceValues, now: Column | None = None, apply_npdb: bool = False,
                     statuses: Sequence[str] | None = None) -> DataFrame:
    """115-column provider rows (target order), with data-quality results.

    Only staff-status rows whose trimmed ``active123`` is in ``statuses`` (by
    default the source's own list, ``values.staff_statuses``) are read.

    ``apply_npdb`` reproduces the source's last qualification step: every
    qualification repeated for each NPDB entry of the provider, its number and
    type overwritten (and the list emptied when the provider has none)."""
    hub = bronze(t["drname"], "drname").withColumnRenamed("drname__dr_id", KEY)
    hub = lookup_chain(hub, [Lookup(bronze(t["u3_tab"], "u3_tab"), "drname__ud3", "u3_tab__cd", "left",
                                    select=["u3_tab__txt"])] + [
        Lookup(bronze(t[table], table), f"drname__{col}", f"{table}__cd", "left", select=[f"{table}__txt"])
        for col, table in AGE_EXTENSIONS.values()] + [
        Lookup(bronze(t[table], table), f"drname__{col}", f"{table}__cd", "left", select=[f"{table}__txt"])
        for col, table in HUB_CODE_TABLES.items()])
    spine = attach(hub, _address_satellite(t, values), KEY, "inner")
    spine = attach(spine, _status_satellite(t, values, values.staff_statuses if statuses is None else statuses), KEY, "inner")
    spine = attach(spine, _plan_satellite(t), KEY, "inner")
    spine = attach(spine, _language_satellite(t), KEY, "left")
    spine = attach(spine, _credential_satellite(t), KEY, "left")
    spine = attach(spine, _specialty_satellite(t), KEY, "left")
    spine = attach(spine, _taxonomy_satellite(t), KEY, "left")
    spine = attach(spine, _expertise_satellite(t), KEY, "left")
    spine = attach(spine, _training_satellite(t), KEY, "left")
    spine = attach(spine, _education_satellite(t), KEY, "left")
    cultural = F.array(of("qualification", description="Cultural Competency Training", qualification_code_display="ud8",
                          qualification_number=F.col("drname__npdb"), qualification_type=F.col("drname__npdbdesc"),
                          status=F.col("drname__ud8")))
    quals = cross_apply("taxonomy_codes", merge_arrays(*[f"status_{c}_qualifications" for c in STATUS_QUALIFICATIONS],
                                                       "board_qualifications", "credential_qualifications", cultural),
                        {"qualification_code": lambda tc, q: tc, "taxonomy": lambda tc, q: tc})
    if apply_npdb:
        npdb = F.array(of("npdb", qualification_number=F.col("drname__npdb"), qualification_type=F.col("drname__npdbdesc")))
        quals = cross_apply(npdb, quals, {
            "qualification_number": lambda n, q: n["qualification_number"],
            "qualification_type": lambda n, q: n["qualification_type"],
            "taxonomy": lambda n, q: q["qualification_code"]}, keep_when_empty=False)
    spine = spine.withColumn("qualifications", quals)
    # school entries join the address lists; both sides are cast to the
    # address element types (made nullable) so they share one element type
    types = {f.name: _nullable(f.dataType) for f in spine.schema.fields}
    spine = spine.withColumns({
        name: merge_arrays(F.col(name).cast(types[name]), F.col(school).cast(types[name]))
        for name, school in (("other_addresses", "other_addresses_school"),
                             ("general_contact_details", "school_general_contact_details"))
    })
    h = lambda n: F.col(f"drname__{n}")
    hub_ids = [keyed_map(F.array(of("identifier", identifier_type=kind, identifier=h(column), identifier_source=source,
                                    exp_date=h("expdate").cast("string") if kind == "Visa" else None)), "identifier_type")
               for kind, (column, source) in HUB_IDENTIFIERS.items()]
    emails = F.sort_array(F.array(of("email", email_type="URL", email=h("email")),
                                  of("email", email_type="App_Module", email=h("appmodule_email"))))
    socials = F.sort_array(F.array(of("social", type="Facebook", url=h("facebook")),
                                   of("social", type="Twitter", url=h("twitter"))))
    accept_txt = F.col("u3_tab__txt")
    hub_var = {
        "ethnic": F.array(of("variable", code_type="Ethinicity", code_value=F.col("eth_tab__cd"),
                             code_description=F.col("eth_tab__txt"))),
        "race": F.array(of("variable", code_type="Race", code_value=F.col("u12_tab__cd"),
                           code_description=F.col("u12_tab__txt"))),
        "fmg": F.array(of("variable", code_type="FMG", code_value=h("fmg").cast("string"),
                          code_description="Qualification Type/Status")),
        "pract": F.array(of("variable", code_type="Practice Code", code_value=h("pract_cd1").cast("string"),
                            code_description=F.col("par_tab__txt"))),
    }

    def hub_value(name: str, column: str) -> Column:
        v = h(column)
        if name == "ud9":
            v = translate(v, EMPLOYMENT_TYPES, keep_other=True)
        elif name == "ud7_date":
            v = v.try_cast("date")
        return v.cast("string")

    hub_values = {name: hub_value(name, column) for name, column in HUB_EXTENSIONS.items()} | {
        name: F.col(f"{table}__txt") for name, (_, table) in AGE_EXTENSIONS.items()}
    ext_lists = {name: F.array(of("extension", source_column_name=name, source_column_value=v)) for name, v in hub_values.items()}
    ext_lists |= {name: F.col(f"education_ext_{i}") for i, name in enumerate(EDUCATION_EXTENSIONS)}
    ext_lists |= {name: F.col(name) for name in EXTENSION_ORDER if name in spine.columns}
    primary = pick("other_addresses", lambda x: x["address_sch_type"] == PRIMARY_SCH_TYPE)
    birth = h("birthdate").try_cast("date")
    filled = {
        "service_provider_id": h("nationalid"),
        "source_service_provider_id": h("dr_no_ext"),
        "service_provider_id_system": F.lit(values.system),
        "service_provider_id_use": F.lit(ID_USE),
        "name_first_name": h("dr_fname"), "name_middle_name": h("dr_iname"), "name_last_name": h("dr_lname"),
        "name_prefix_name": h("drsal"), "name_suffix_name": h("drsuffix"),
        "alternate_name_name": full_name(h("dr_fname"), h("dr_iname"), h("dr_lname")),
        **{f"address_{f}": primary[f] for f in ("address_type", "address_use", "address_line_1", "address_line_2", "city",
                                                 "county", "state_province", "postal_code", "zip_code_extension", "country",
                                                 "longitude", "latitude", "eff_date", "exp_date", "locality_code")},
        "other_addresses": F.col("other_addresses"),
        "primary_phone_number": pick("primary_phone_array", lambda x: x["reference_id"] == PRIMARY_SCH_TYPE, "primary_phone"),
        "other_phones": F.col("other_phones"),
        "email_email": h("email"),
        "other_emails": emails,
        "other_social_profiles": socials,
        "accept_new_patient": F.when(accept_txt.isin(ACCEPTING), accept_txt),
        "accept_new_patient_from_network": F.when(~accept_txt.isin(ACCEPTING), accept_txt),
        "general_contact_details": F.col("general_contact_details"),
        "social_profile_social_profile_type": F.lit("Facebook"),
        "social_profile_profile_url": h("facebook"),
        "pcp_ind": F.col("pcp_ind"), "service_provider_role": F.col("service_provider_role"),
        "base_demographic_gender": h("gender"), "base_demographic_race": h("ud12"),
        "base_demographic_ethnicity": h("ethnic"), "base_demographic_marital_status": h("marital"),
        "base_demographic_nationality": h("citisen"), "base_demographic_citizenship": h("citisen"),
        "national_id": h("ss_no"), "npi": h("nationalid"),
        "tin": pick("other_tax_id", lambda x: x["reference_id"] == PRIMARY_SCH_TYPE, "tax_id"),
        "active": F.lit(True),
        "birth_date_of_birth": birth, "birth_year_of_birth": F.year(birth), "birth_birthplace": h("birthplace"),
        "language_language_code": F.get(F.col("other_languages"), F.lit(0))["language_code"],
        "other_languages": F.col("other_languages"),
        "networks": F.col("networks"),
        "qualifications": F.col("qualifications"),
        "education": F.col("education"),
        "specialty": merge_arrays("specialty_list", "taxonomy_spec", "expertise_spec"),
        "reference_ids": F.col("address_reference_ids"),
        # in the source's order
        "variable_fields": merge_arrays("status_active_variable", "status_udf1_variable", "status_udf21_variable",
                                        "status_udf22_variable", "status_staff_variable", hub_var["ethnic"],
                                        hub_var["race"], hub_var["fmg"], "drplan1_u3ins_variable", "location_variable",
                                        "educ_tab_variable", "expertise_variable", hub_var["pract"], "apos_variable",
                                        "hospital_variable", "affi_arr_variable"),
        "source_name": F.lit(values.system),
        "source_id": F.col(KEY),
        "identifiers": merge_maps(*hub_ids[:5], "status_medicare_identifiers", "status_medicaid_identifiers", *hub_ids[5:],
                                  "train_identifiers"),
        "extension_source_values": merge_arrays(*[ext_lists[name] for name in EXTENSION_ORDER if name in ext_lists]),
    }
    out = spine.select(*[(filled[c] if c in filled else F.lit(None).cast("string")).alias(c)
                         for c in TARGET_COLUMNS if c != "data_quality_result"])
    out = flatten_results(apply_rules(out, DQ_RULES, now))
    return out.withColumn("source_authoritative_ind", F.lit(True)).select(*TARGET_COLUMNS)
