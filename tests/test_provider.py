"""The provider profile on small bronze fixture tables (columns as listed in
FIXTURES.md §1)."""

import os

import pytest
from pyspark.sql import functions as F

from tapestry.plans.provider import TARGET_COLUMNS, SourceValues, provider_profile

VALUES = SourceValues.load(os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "source_values.json"))

DAYS = ["sun", "mon", "tues", "wednes", "thurs", "fri", "satur"]


def table(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


@pytest.fixture(scope="module")
def tables(spark):
    addr_cols = ["dr_id", "sch_type", "addr", "addr2", "city", "county", "countycd", "state", "zip", "nation", "longitude",
                 "latitude", "effdate", "termdate", "handicap", "loc_code", "udf3", "link", "phone", "extension", "fax"] + \
                [f"{d}_{x}" for d in DAYS for x in ("s1", "s2", "e1", "e2")]

    def addr(dr, sch, link, zip_, udf3, first_shift_empty):
        sched = []
        for _ in DAYS:
            sched += ["" if first_shift_empty else "08:00", "09:00", "17:00", "18:00"]
        return [dr, sch, "1 Main St", None, "Town", "Cnty", "C1", "MD", zip_, "US", "-76.6", "39.3", "2020-01-01", None,
                "Y", " L1 ", udf3, link, "410-555-0100", "12", "410-555-0199"] + sched

    t = {
        "address1": table(spark, addr_cols, [addr("1", "HFC2", "k1", "21201-1234", "Y", False),
                                             addr("1", "BILL", "k2", "21202", "N", True),
                                             addr("2", "HFC2", "k3", "21203", None, False)]),
        "address2": table(spark, ["l_address", "tax_id"], [("k1", "123456789012"), ("k2", "999"), ("k3", "555")]),
        "addr_arr": table(spark, ["cd", "txt"], [("HFC2", "Primary"), ("BILL", "Billing")]),
        "loc_tab": table(spark, ["cd", "txt"], [("L1", "Baltimore")]),
        "stfstatu": table(spark, ["dr_id", "staff_cd", "active123", "udf1", "udf21", "udf22", "rec_date", "rea_date",
                                  "l_secfile", "medicare", "medicaid", "pcp_spec"],
                          [("1", "S1", "A", "1", "NOC", "TNC", "2021-01-01", None, "f", "MC1", "MD1", "P"),
                           ("1", "S1", "A", "7", None, None, None, None, None, "MC2", None, "P"),
                           ("2", "S2", "B", None, None, None, None, None, None, None, None, "S")]),
        "sta_tab": table(spark, ["cd", "txt"], [("S1", "Staff one")]),
        "rec_arr": table(spark, ["cd", "txt"], [("A", "Active"), ("B", "Board")]),
        "dr_plan1": table(spark, ["dr_id", "plan_cd", "status", "vstart", "eend", "l_par_code", "l_u3ins_tb", "pcp_spec"],
                          [("1", "P1", "A", "2020-01-01", None, "PAR", "T1", "P"),
                           ("1", "P2", "A", "2021-01-01", None, None, None, "P"),
                           ("1", "P3", "T", "2019-01-01", "2019-12-31", None, None, None),
                           ("2", "P1", "T", "2018-01-01", None, None, None, None)]),
        "ins_plan": table(spark, ["cd", "txt", "subname"], [("P1", "Plan one", "HMO"), ("P2", "Plan two", "PPO")]),
        "u3ins_tb": table(spark, ["cd", "txt"], [("T1", "Term one")]),
        "contract_status": table(spark, ["cd", "txt", "link"], [("A", "ACTIVE", "x"), ("T", "Terminated", "y")]),
        "dr_lan": table(spark, ["dr_id", "lan_cd", "seq"], [("1", "SPA", "2"), ("1", "ENG", "1")]),
        "lan_tab": table(spark, ["cd", "txt"], [("ENG", "English"), ("SPA", "Spanish")]),
        "credent": table(spark, ["dr_id", "cd", "sch_type", "title", "issue_dt", "lic_date", "lic_num", "status"],
                         [("1", "MD", "LIC", "Physician", "2000-01-01", "2030-01-01", "L-1", "A"),
                          ("1", "VA", "LIC", "Physician", "2001-01-01", None, "L-2", "A"),
                          ("1", "XX", "LIC", "Unknown state", None, None, "L-3", "A")]),
        "lic_arr": table(spark, ["cd", "txt", "lic_udf1"], [("LIC", "State license", None)]),
        "statelic": table(spark, ["cd", "txt"], [("MD", "Maryland board"), ("VA", "Virginia board")]),
        "taxonomy": table(spark, ["dr_id", "cd"], [("1", "207Q"), ("1", "208D"), ("2", "111")]),
        "dr_spec": table(spark, ["dr_id", "specialty", "primspec", "bd_cert", "year_cert", "year_recert"],
                         [("1", "FAM", "Y", "1", "2005", "2015"), ("1", "PED", "N", None, None, None)]),
        "spec_tab": table(spark, ["cd", "txt"], [("FAM", "Family medicine"), ("PED", "Pediatrics")]),
        "taxo_arr": table(spark, ["cd", "descript"], [("207Q", "Family"), ("207Q", "Family"), ("208D", "General")]),
        "dr_expert": table(spark, ["dr_id", "expertise"], [("1", "E1"), ("2", "E2")]),
        "exp_tab": table(spark, ["cd", "txt"], [("E1", "Diabetes")]),
        "drname": table(spark, ["dr_id", "nationalid", "dr_no_ext", "dr_fname", "dr_iname", "dr_lname", "drsal", "drsuffix",
                                "email", "facebook", "gender", "ud12", "ethnic", "marital", "citisen", "ss_no",
                                "birthdate", "birthplace", "npdb", "npdbdesc", "medicare", "medicaid", "visa", "expdate",
                                "upin", "nudf1", "efmg_no", "appmodule_email", "twitter", "ud3", "ud8", "ud9", "ud7_date",
                                "ud1", "ud2", "drtitle", "pict1", "ud7", "pict2", "verfac", "beeper", "beeper2",
                                "ud13_date", "ud14_date", "ud15_date", "fmg", "pract_cd1"],
                        [("1", "1234567890", "X1", "Ann", None, "Lee", "Dr", None, "a@x", None, "F", None, None, "M", "US",
                          "111", "1970-05-06", "Here", "N-9", "report", "DM1", None, "V1", "2030-01-01", "U1", "CAQ",
                          None, "app@x", "@ann", "AC", "Y", "C", "2020-02-03", "A0", "A99", "MD", None, None, None,
                          "VF", None, None, None, None, None, "Y", "PC1"),
                         ("2", "123", "X2", "Bo", "Q", "Kim", None, None, None, None, "X", None, None, None, None,
                          None, "1890-01-01", None, None, None, None, None, None, None, None, None, None, None, None,
                          "NW", None, "Z", "bad", None, None, None, None, None, None, None, None, None, None, None,
                          None, None, None)]),
        "eth_tab": table(spark, ["cd", "txt"], [("H", "Hispanic")]),
        "u12_tab": table(spark, ["cd", "txt"], [("W", "White")]),
        "par_tab": table(spark, ["cd", "txt"], [("PC1", "Solo practice")]),
        "u1_tab": table(spark, ["cd", "txt"], [("A0", "0")]),
        "u2_tab": table(spark, ["cd", "txt"], [("A99", "99")]),
        "u3_tab": table(spark, ["cd", "txt"], [("AC", "Accepting New Patients"), ("NW", "Network only")]),
        "train": table(spark, ["dr_id", "cd", "position", "sch_type", "fdate", "tdate"],
                       [("1", "H1", "RES", "AF", "2000-07-01", "2003-06-30"), ("1", "H2", "FEL", None, None, None)]),
        "hospital": table(spark, ["cd", "txt", "addr", "addr2", "city", "state", "zip", "nation", "homehtml", "contact1",
                                  "phone", "fax", "email", "note"],
                          [("H1", "General Hospital", "5 Care St", None, "Town", "MD", "21201", "US", "http://h",
                            "Dr House", "410", None, "h@x", "teaching")]),
        "educate": table(spark, ["dr_id", "cd", "sch_type", "degree", "fdate", "tdate", "cmt1", "link", "notes"],
                         [("1", "H1", "MED", "MD", "1990-09-01", "1994-06-01", "MD program", "lk", "honors"),
                          ("1", "S2", "MED", "MD", None, None, None, None, None)]),
        "educ_arr": table(spark, ["cd", "txt"], [("MED", "Medical school")]),
        "school": table(spark, ["cd", "txt", "subname", "contact1", "contact2", "addr", "addr2", "city", "state", "zip", "nation",
                                "email"],
                        [("H1", "University", "Medicine", "Dean A", "Dean B", "9 Campus Rd", None, "Uni", "MD", "21218-0001", "US",
                          "s@x"),
                         ("S2", "College", None, None, None, None, None, None, None, None, None, None)]),
        "educ_tab": table(spark, ["cd", "txt"], [("MD", "Doctor of Medicine")]),
        "apos_tab": table(spark, ["cd", "txt"], [("RES", "Residency"), ("FEL", "Fellowship")]),
        "affi_arr": table(spark, ["cd", "txt"], [("AF", "Affiliated")]),
    }
    return t


@pytest.fixture(scope="module")
def profile_rows(tables):
    out = provider_profile(tables, VALUES, now=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert out.columns == TARGET_COLUMNS and len(TARGET_COLUMNS) == 115
    return out.collect()


def test_provider_profile(profile_rows):
    rows = profile_rows
    # provider 2 has no active plan status -> no row; provider 1 keeps its active status only
    assert [r.source_id for r in rows] == ["1"]
    r = rows[0]
    assert r.address_address_use == "work" and r.address_postal_code == "21201" and r.address_zip_code_extension == "1234"
    assert r.address_locality_code == "L1" and r.tin == "1234567890"  # bronze strings are trimmed at load
    assert r.primary_phone_number == "410-555-0100"
    assert sorted(a.address_use or "" for a in r.other_addresses) == ["", "billing", "work"]  # + the school address
    assert {a.print_in_directory_ind for a in r.other_addresses} == {True, False, None}
    assert len(r.general_contact_details) == 14 + 2  # 7 days x 2 addresses + 2 school contacts
    starts = {(c.available_days_of_week, c.available_start_time) for c in r.general_contact_details}
    assert ("sun", "08:00") in starts and ("sun", "09:00") in starts  # empty first shift falls back to the second
    # a status row without a Medicaid number still yields an identifier struct (fields NULL), as collected
    assert sorted(k for k in r.identifiers if k.startswith("Stfstatu")) == [
        "Stfstatu_Medicaid_1", "Stfstatu_Medicaid_2", "Stfstatu_Medicare_1", "Stfstatu_Medicare_2"]
    assert sorted(k for k in r.identifiers if not k.startswith(("Stfstatu", "Training"))) == [
        "CAQH", "Drname_Medicaid", "Drname_Medicare", "NPI", "UPIN", "Visa", "efmg number"]
    assert (r.pcp_ind, r.service_provider_role) == (True, "PCP")
    assert sorted(n.plan_id for n in r.networks) == ["P1", "P2"]
    assert [l.language_code for l in r.other_languages] == ["ENG", "SPA"] and r.language_language_code == "ENG"
    descriptions = {v.code_type: v.code_description for v in r.variable_fields if v.code_value == "1" or v.code_value == "NOC"}
    assert descriptions["EPSDT"] == "MD Medicaid EPSDT Certified" and descriptions["DC Healthcheck"] == "Not Certified"
    assert r.alternate_name_name == "Ann Lee" and r.birth_year_of_birth == 1970 and r.source_authoritative_ind is True
    assert [x.rule for x in r.data_quality_result] == ["source_id must be service_provider_id"]


def test_provider_qualifications(spark, tables, profile_rows):
    r = profile_rows[0]
    # two licenses with a known state board x two taxonomy codes (the unknown board drops out: inner lookup)
    got = sorted((q.license_number, q.qualification_code, q.taxonomy) for q in r.qualifications if q.license_number)
    assert got == [("L-1", "207Q", "207Q"), ("L-1", "208D", "208D"), ("L-2", "207Q", "207Q"), ("L-2", "208D", "208D")]
    # two distinct board entries (one certified, one all-NULL but for the description) x two codes
    boards = [q for q in r.qualifications if q.description == "Board Certified"]
    assert len(boards) == 4 and {(q.issue_date, q.renew_date, q.status) for q in boards} == {("2005", "2015", "1"), (None, None, None)}
    r2 = provider_profile(tables, VALUES, apply_npdb=True).first()
    assert {(q.qualification_number, q.qualification_type) for q in r2.qualifications} == {("N-9", "report")}
    assert len(r2.qualifications) == 22 and {q.taxonomy for q in r2.qualifications} == {"207Q", "208D"}


def test_provider_specialty(spark, tables, profile_rows):
    r = profile_rows[0]
    got = sorted((s.type, s.code_value, s.specialty_description) for s in r.specialty)
    assert got == [("Expertise", "E1", "Diabetes"), ("Specialty", "FAM", "Family medicine"), ("Specialty", "PED", "Pediatrics"),
                   ("Taxonomy", "207Q", "Family"), ("Taxonomy", "208D", "General")]
    assert [v.code_description for v in r.variable_fields if v.code_type == "Expertise"] == ["Diabetes"]


def test_provider_hub_lists(spark, tables, profile_rows):
    r = profile_rows[0]
    assert [(e.email_type, e.email) for e in r.other_emails] == [("App_Module", "app@x"), ("URL", "a@x")]
    assert [(s.type, s.url) for s in r.other_social_profiles] == [("Facebook", None), ("Twitter", "@ann")]
    assert (r.accept_new_patient, r.accept_new_patient_from_network) == ("Accepting New Patients", None)
    ids = r.identifiers
    assert ids["Visa"].identifier == "V1" and ids["Visa"].exp_date == "2030-01-01" and ids["Visa"].eff_date is None
    assert ids["NPI"].identifier_source == "NPI" and ids["CAQH"].identifier == "CAQ"
    assert ids["Drname_Medicare"].identifier == "DM1" and ids["Drname_Medicaid"].identifier is None
    cultural = [q for q in r.qualifications if q.description == "Cultural Competency Training"]
    assert {(q.qualification_number, q.status, q.taxonomy) for q in cultural} == {("N-9", "Y", "207Q"), ("N-9", "Y", "208D")}


def test_provider_training(spark, tables, profile_rows):
    r = profile_rows[0]
    ids = {k: v for k, v in r.identifiers.items() if k.startswith("Training")}
    assert sorted(ids) == ["Training_1", "Training_2"]
    res = [v for v in ids.values() if v.identifier == "RES"][0]
    # dates by name: eff = from-date, exp = to-date (the positional swap of the source is fixed)
    assert (res.eff_date, res.exp_date) == ("2000-07-01T00:00:00.000Z", "2003-06-30T00:00:00.000Z")
    assert res.identifier_source == "Provider_Train" and len(res.reference_id) == 32
    places = {(v.code_value, v.code_description) for v in r.variable_fields if v.code_type == "Place of Training"}
    assert places == {("H1", "General Hospital"), (None, None)}


def test_provider_education(profile_rows):
    r = profile_rows[0]
    # S2 is a school but not a hospital code: both lookups must match, so it drops out
    assert [(e.school_name, e.department, e.degree, e.start_year, e.end_year) for e in r.education] == [
        ("University", "Medicine", "MD", 1990, 1994)]
    assert [x.source_column_value for x in r.extension_source_values if x.source_column_name == "Educate_Code"] == ["H1"]


def test_provider_hub_extensions(profile_rows):
    r = profile_rows[0]
    ext = {x.source_column_name: x.source_column_value for x in r.extension_source_values}
    assert ext["ud9"] == "1099/Contracted" and ext["ud7_date"] == "2020-02-03" and ext["Dr_Title"] == "MD"
    assert ext["Verfac"] == "VF" and ext["Min_Patient_Age"] == "0" and ext["Max_Patient_Age"] == "99"
    assert "Cellphone" not in ext  # computed by the source but never written to the entity


def test_provider_school_entries(profile_rows):
    r = profile_rows[0]
    school = [a for a in r.other_addresses if a.address_line_1 == "9 Campus Rd"]
    assert len(school) == 1 and school[0].postal_code == "21218" and school[0].reference_id == "1"
    assert sorted(c.contact_name for c in r.general_contact_details if c.entity_type == "School") == ["Dean A", "Dean B"]


def test_provider_status_qualifications(profile_rows):
    r = profile_rows[0]
    got = {(q.description, q.qualification_code_display, q.status) for q in r.qualifications
           if q.qualification_code_display in ("udf1", "udf21", "udf22")}
    assert got == {("EPDST", "udf1", "1"), ("EPDST", "udf1", "7"), ("DC Health Check", "udf21", "NOC"),
                   ("DC Health Check", "udf21", None), ("Flouride Varnish", "udf22", "TNC"), ("Flouride Varnish", "udf22", None)}
    # the merged list starts with the status sets, as in the source
    assert r.qualifications[0].qualification_code_display == "udf22"


def test_provider_variables(profile_rows):
    r = profile_rows[0]
    types = [v.code_type for v in r.variable_fields]
    # source order: status variables first, then hub ethnicity/race/FMG, ..., practice code, training
    assert types.index("Active123") < types.index("Ethinicity") < types.index("FMG") < types.index("Practice Code")
    got = {v.code_type: (v.code_value, v.code_description) for v in r.variable_fields
           if v.code_type in ("FMG", "Practice Code", "Education")}
    assert got == {"FMG": ("Y", "Qualification Type/Status"), "Practice Code": ("PC1", "Solo practice"),
                   "Education": ("MD", "Doctor of Medicine")}


def test_provider_education_extensions(profile_rows):
    r = profile_rows[0]
    ext = {x.source_column_name: x.source_column_value for x in r.extension_source_values}
    assert ext["education_program"] == "MD program" and ext["cmt1"] == "MD program" and ext["education_notes"] == "honors"
    assert ext["School_Code"] == "H1" and ext["school_email"] == "s@x"
    assert ext["hospital_url"] == "http://h" and ext["hospital_comments"] == "teaching" and ext["hospital_fax"] is None


def test_provider_credential_extensions(spark, tables):
    credent = tables["credent"].withColumns({"link": F.concat(F.lit("k-"), "cd"), "notes": F.when(F.col("cd") == "MD", "seen")})
    statelic = tables["statelic"].withColumns({"state": F.col("cd"), "email": F.lower("cd"), "ver_elec": F.when(F.col("cd") == "VA", F.lit(1))})
    r = provider_profile(tables | {"credent": credent, "statelic": statelic}, VALUES).first()
    values = [(x.source_column_name, x.source_column_value) for x in r.extension_source_values]
    at = values.index(("Credent_Code", "VA"))
    assert values[at:at + 12] == [
        ("Credent_Code", "VA"), ("Credent_Code", "MD"), ("Credent_Link", "k-VA"), ("Credent_Link", "k-MD"), ("Credent_Notes", "seen"),
        ("Credent_Notes", None), ("Credent_State", "VA"), ("Credent_State", "MD"), ("Credent_Email", "va"), ("Credent_Email", "md"),
        ("Credent_Verification", "1"), ("Credent_Verification", None)]
    # the source's order: hub, address, education codes before; beepers, plan, school, hospital after
    assert values[at - 1][0] == "Educate_Link" and values[at + 12][0] == "Beeper"
    assert values[0][0] == "Verfac" and values[-1][0] == "hospital_comments"


def test_provider_staff_statuses(spark, tables):
    more = table(spark, tables["stfstatu"].columns, [("1", "S9", " X ", "1", *[None] * 8), ("1", "S8", " Q ", "1", *[None] * 8)])
    got = tables | {"stfstatu": tables["stfstatu"].union(more)}
    codes = lambda r: sorted(v.code_value for v in r.variable_fields if v.code_type == "Active123")
    assert codes(provider_profile(got, VALUES).first()) == ["A", "A", "Q"]
    assert codes(provider_profile(got, VALUES, statuses=["X"]).first()) == ["X"]
    assert provider_profile(got, VALUES, statuses=["B"]).count() == 0
